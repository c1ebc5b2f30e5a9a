"""Personal data and secrets by a semi-Markov conditional random field.

A line is a row of atoms: runs of letters and digits, and single signs. A segment is up to ``MOST`` atoms with at most one
space between neighbours; it must hold a digit, an ``@``, 16 capitals in a row, a word of 16 letters that changes case all the time, or a word that stands for the value of a key word. Features describe a whole segment: how many digits,
which signs, whether the form as a whole is that of an address, number or key, what stands directly before and after it. Every type has its own weights;
everything outside of entities scores 0. The dynamic programme over segment ends picks the boundaries and types
with the highest joint score, exactly. The bound of ``MOST`` atoms cuts nothing off: an address of more atoms than that is taken whole, by its form (``long_addresses``).

As segments hold one of these, the programme runs on the islands of atoms within reach of one, which is the same as to run it
on everything. The weights are fitted by maximum likelihood (forward-backward over the same segments) on sentences that are made here, from a fixed seed,
with entities in several written forms and with numbers that aren't entities; nothing of the corpus is used.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import slices, table, utf8

TYPES = ("email", "phone", "ip", "card", "secret", "ssn", "iban")
MOST = 32

_KIND = np.full(256, 2, np.uint8)  # 0 space, 1 letter or digit, 2 sign
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:256] = 1
_TRIGGER = np.zeros(256, bool)
_TRIGGER[48:58] = True
_TRIGGER[64] = True
#: Signs between a key word and its value.
_TELLS = np.frombuffer(b"=:\"'", np.uint8)
_KEYS = (b"token", b"password", b"passwd", b"pwd", b"secret", b"key", b"apikey", b"auth", b"bearer", b"credential")


def line_borders(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where texts and lines begin and end; nothing looks across these."""
    return np.unique(np.concatenate((offs, np.flatnonzero(data == 10) + 1)))


class Atoms:
    """The atoms of some lines, with the numbers that segments are described by."""

    def __init__(self, data: np.ndarray, offs: np.ndarray) -> None:
        kind = _KIND[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offs] = True
        word = kind == 1
        before = np.concatenate(([False], word[:-1]))
        after = np.concatenate((word[1:], [False]))
        sign = kind == 2
        self.begin = b = np.flatnonzero(sign | (word & (~before | edge[:-1])))
        self.end = e = np.flatnonzero(sign | (word & (~after | edge[1:]))) + 1
        self.owner = np.searchsorted(offs, b, "right") - 1
        n = len(b)

        def per_atom(flag: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
            return total[e] - total[b]

        digit = (data >= 48) & (data < 58)
        upper, lower = (data >= 65) & (data < 91), (data >= 97) & (data < 123)
        self.size = e - b
        self.digits, self.upper, self.lower = per_atom(digit), per_atom(upper), per_atom(lower)
        hexa = per_atom(digit | ((data >= 97) & (data < 103)) | ((data >= 65) & (data < 71)))
        first = data[b] if n else np.zeros(0, np.uint8)
        is_word = _KIND[first] == 1
        self.number = is_word & (self.digits == self.size)
        self.alpha = is_word & (self.digits == 0)
        self.trigger = (self.digits > 0) | (first == 64) | (is_word & (self.size >= 16) & (self.upper == self.size))
        turn = np.concatenate(([False], (upper[1:] & lower[:-1]) | (lower[1:] & upper[:-1])))[: len(data)]
        self.jagged = is_word & (self.size >= 16) & (self.upper + self.lower == self.size) & (per_atom(turn) * 5 >= self.size * 2)
        self.trigger |= self.jagged
        self.first = first
        self.word = is_word
        self.long = is_word & (self.size >= 16) & self.trigger & (self.digits < self.size) & ((hexa == self.size) | ((self.upper > 0) & (self.upper + self.digits + self.lower == self.size)))
        self.prefixed = np.zeros(n, bool)
        at = np.flatnonzero(is_word & (self.size >= 16))
        if len(at):
            self.prefixed[at] = (data[b[at][:, None] + np.arange(4)] == np.frombuffer(b"AKIA", np.uint8)).all(axis=1)
        self.coded = np.zeros(n, bool)  # two capitals and two digits first
        at = np.flatnonzero(is_word & (self.size >= 4) & (self.upper + self.digits == self.size))
        if len(at):
            self.coded[at] = upper[b[at]] & upper[b[at] + 1] & digit[b[at] + 2] & digit[b[at] + 3]
        self.hexa = is_word & (self.size <= 4) & (hexa == self.size)
        value = np.zeros(n, np.int64)
        for i in range(3):
            use = self.number & (self.size > i)
            value[use] = value[use] * 10 + data[b[use] + i] - 48
        self.over = self.number & ((self.size > 3) | (value > 255))
        # gap to the atom before: 0 none, 1 one space, 2 more, a line break or another text
        self.gap = np.full(n + 1, 2, np.int64)
        if n > 1:
            g = np.minimum(b[1:] - e[:-1], 2)
            g[self.owner[1:] != self.owner[:-1]] = 2
            self.gap[1:n] = g
        self.key = np.zeros(n, bool)
        for word_ in _KEYS:
            at = np.flatnonzero(is_word & (self.size == len(word_)))
            if len(at):
                text = data[b[at][:, None] + np.arange(len(word_))] | 32
                self.key[at] |= (text == np.frombuffer(word_, np.uint8)).all(axis=1)
        near = self.key.copy()
        for i in range(1, 4):
            near[i:] |= self.key[:-i] & (self.owner[i:] == self.owner[:-i])
        self.after_key = np.concatenate(([False], near[:-1])) if n else near
        told = np.concatenate(([False], np.isin(first[:-1], _TELLS))) if n else near
        self.given = is_word & self.after_key & told & (self.gap[:n] < 2) & (self.size >= 6)
        self.trigger |= self.given


#: Signs by number, for counts inside a segment.
_SIGNS = {c: i for i, c in enumerate(b".@-+()=\"_:/")}


def segments(a: Atoms) -> tuple[np.ndarray, np.ndarray]:
    """First atom and length of each segment, by first atom."""
    n = len(a.begin)
    trig = np.concatenate(([0], np.cumsum(a.trigger)))
    wide = np.concatenate(([0], np.cumsum(a.gap[:n] == 2)))
    out_i, out_l = [], []
    alive = np.arange(n)
    for length in range(1, MOST + 1):
        alive = alive[alive + length <= n]
        alive = alive[wide[alive + length] == wide[alive + 1]]
        ok = alive[trig[alive + length] > trig[alive]]
        out_i.append(ok)
        out_l.append(np.full(len(ok), length))
    return np.concatenate(out_i), np.concatenate(out_l)


def describe(a: Atoms, i: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The features of each segment, as float32."""
    n = len(a.begin)
    j = i + length

    def total(x: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
        return c[j] - c[i]

    of = {c: total(a.first == c) for c in _SIGNS}
    dots, at, dash, plus, left, right, equals, quote = (of[c] for c in b".@-+()=\"")
    digits, numbers, alphas, words = total(a.digits), total(a.number), total(a.alpha), total(a.word)
    signs = length - words
    spaces = total(np.concatenate((a.gap[:n] == 1,))) - (a.gap[i] == 1)
    odd = signs - dots - at - dash - plus - left - right - of[ord("_")]
    last = j - 1
    first_word, last_word = a.word[i], a.word[last]
    nxt, prv = np.minimum(j, n - 1), np.maximum(i - 1, 0)
    has_next, has_prev = (a.gap[j] < 2) & (j < n), (a.gap[i] < 2) & (i > 0)
    touch_next, touch_prev = has_next & (a.gap[j] == 0), has_prev & (a.gap[i] == 0)
    joins = np.isin(a.first, np.frombuffer(b".@-_+", np.uint8))
    nxt2 = np.minimum(j + 1, n - 1)
    unclean_right = touch_next & (a.word[nxt] | (joins[nxt] & (j + 1 < n) & (a.gap[nxt2] == 0) & a.word[nxt2]))
    prv2 = np.maximum(i - 2, 0)
    unclean_left = touch_prev & (a.word[prv] | (joins[prv] & (i > 1) & (a.gap[prv] == 0) & a.word[prv2]))
    digit_next, digit_prev = has_next & a.number[nxt], has_prev & a.number[prv]
    before_is = np.where(has_prev, a.first[prv], 0)
    tail = (length >= 3) & a.alpha[last] & (a.first[np.maximum(j - 2, 0)] == 46) & (a.size[last] >= 2)
    email = (at == 1) & tail & (spaces == 0) & first_word & (plus + left + right + odd + signs - signs == left + right) & (left + right == 0)
    quad = (length == 7) & (dots == 3) & (numbers == 4) & (spaces == 0)
    plain = words == numbers
    groups = plain & (signs == dash)
    card = groups & (digits >= 13) & (digits <= 19) & ((length == 1) | ((numbers == 4) & (a.size[i] == 4))) & first_word & last_word
    dial = plain & (signs == plus + left + right + dash + dots) & (digits >= 9) & (digits <= 15) & (left == right) & (left <= 1) & (plus <= 1) & last_word
    formed = dial & ((plus == 1) & (a.first[i] == 43) | (left == 1) | ((numbers >= 3) & (dots + dash + spaces >= 2))) & (plus == (a.first[i] == 43))
    long = (length == 1) & a.long[i]
    caps = long & (a.lower[i] == 0)
    inside = total(a.size * a.word)
    social = plain & (length == 5) & (dash == 2) & (spaces == 0) & (digits == 9) & (a.size[i] == 3) & (a.size[np.minimum(i + 2, n - 1)] == 2)
    account = a.coded[i] & (inside >= 15) & (inside <= 34) & (total(a.word & (a.upper + a.digits == a.size)) == length) & ((length == 1) | (a.size[i] == 4) & (total(a.word & (a.size == 4)) >= length - 1) & (spaces == length - 1))
    colons, double = of[ord(":")], total(np.concatenate(([False], (a.first[1:] == 58) & (a.first[:-1] == 58) & (a.gap[1:n] == 0)))[:n])
    sixth = (spaces == 0) & (colons == signs) & (total(a.hexa) == words) & (words <= 8) & ((colons == 7) & (words == 8) & (double == 0) | (double == 1) & (words >= 3) & (colons <= 7)) & first_word & last_word
    keyed = a.after_key[i] & ((before_is == 61) | (before_is == 58) | (before_is == 34) | (before_is == 39))
    columns = [
        np.ones(len(i)), email, (at == 1) & ~email, at > 1, quad & (total(a.over) == 0), quad & (total(a.over) > 0), card, card & np.isin(a.first[i], np.frombuffer(b"3456", np.uint8)), dial, formed,
        formed & (plus == 1), formed & (left == 1), long, caps, long & (a.size[i] >= 32), keyed, (length == 1) & keyed & (a.size[i] >= 8) & (a.digits[i] > 0), unclean_left, unclean_right, digit_next, digit_prev,
        touch_prev & a.word[prv], has_prev & (a.gap[i] <= 1) & ((before_is == 43) | (before_is == 40)), spaces > 0, spaces > 3, ~first_word, ~last_word, odd > 0, equals + quote > 0, digits < 7, digits > 16, (alphas > 0) & (at == 0), dots > 0, np.log1p(length),
        touch_prev & (before_is == 36), plain & (length == 1), long & a.prefixed[i], long & (a.digits[i] == 0),
        social, social & ~unclean_left & ~unclean_right, account, account & (length > 1), sixth, double > 1,
        (length == 1) & a.given[i], (length == 1) & a.given[i] & (a.gap[i] == 0), (length == 1) & a.jagged[i],
    ]
    return np.stack([np.asarray(c, np.float32) for c in columns], axis=1)


def islands(a: Atoms) -> tuple[np.ndarray, np.ndarray]:
    """First atom and number of atoms of each stretch that a segment can lie in: cut where no segment crosses."""
    n = len(a.begin)
    near = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(a.trigger)
    np.add.at(near, np.maximum(at - MOST + 1, 0), 1)
    np.add.at(near, np.minimum(at + MOST, n), -1)
    inside = np.cumsum(near[:n]) > 0
    fresh = inside & (~np.concatenate(([False], inside[:-1])) | (a.gap[:n] == 2))
    start = np.flatnonzero(fresh)
    ends = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False])) | np.concatenate((fresh[1:], [True]))))
    return start, ends - start + 1


def _grid(a: Atoms, i: np.ndarray, length: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Scores by first atom and length; what is no segment has -inf."""
    full = np.full((len(a.begin), MOST), -np.inf)
    full[i, length - 1] = score
    return full


def _steps(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(t, first atoms, slots of the state before the first atom) of the islands with more than t atoms."""
    order = np.argsort(-size, kind="stable")
    base = start + np.arange(len(start))
    for t in range(int(size.max()) if len(size) else 0):
        on = order[: np.searchsorted(-size[order], -t, "left")]
        yield t, start[on], base[on]


def decode(a: Atoms, i: np.ndarray, length: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First atom, length and type of the entities of the best labelling. Ties go to outside, then to the shorter segment, then to the first type."""
    grid = _grid(a, i, length, scores.max(axis=1))
    kind = np.zeros((len(a.begin), MOST), np.int8)
    kind[i, length - 1] = scores.argmax(axis=1)
    start, size = islands(a)
    best = np.zeros(len(a.begin) + len(start))
    back = np.zeros(len(best), np.int8)
    for t, first, base in _steps(start, size):
        top, how = best[base + t].copy(), np.zeros(len(first), np.int8)
        for l in range(1, min(MOST, t + 1) + 1):
            s = best[base + t + 1 - l] + grid[first + t + 1 - l, l - 1]
            more = s > top
            top[more], how[more] = s[more], l
        best[base + t + 1], back[base + t + 1] = top, how
    found = []
    for k in range(len(start)):
        t, base = int(size[k]), int(start[k]) + k
        while t > 0:
            l = int(back[base + t])
            if l:
                found.append((int(start[k]) + t - l, l))
            t -= max(l, 1)
    if not found:
        return (np.zeros(0, np.int64),) * 3
    f = np.array(sorted(found))
    return f[:, 0], f[:, 1], kind[f[:, 0], f[:, 1] - 1].astype(np.int64)


def _posterior(a: Atoms, i: np.ndarray, length: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """P(segment, type) for each segment and type."""
    summed = np.logaddexp.reduce(scores, axis=1)
    grid = _grid(a, i, length, summed)
    start, size = islands(a)
    n = len(a.begin) + len(start)
    alpha, beta = np.zeros(n), np.zeros(n)
    steps = list(_steps(start, size))
    for t, first, base in steps:
        terms = [alpha[base + t]] + [alpha[base + t + 1 - l] + grid[first + t + 1 - l, l - 1] for l in range(1, min(MOST, t + 1) + 1)]
        alpha[base + t + 1] = np.logaddexp.reduce(terms, axis=0)
    for t, first, base in reversed(steps):
        island = np.searchsorted(start, first)
        terms = [beta[base + t + 1]]
        for l in range(1, MOST + 1):
            fits = t + l <= size[island]
            terms.append(np.where(fits, beta[np.minimum(base + t + l, n - 1)] + grid[first + t, l - 1], -np.inf))
        beta[base + t] = np.logaddexp.reduce(terms, axis=0)
    island = np.searchsorted(start, i, "right") - 1
    base = start[island] + island
    z = alpha[base + size[island]]
    at = i + island
    return np.exp(alpha[at][:, None] + scores + beta[at + length][:, None] - z[:, None])


def examples(n: int, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Made sentences with the places and types of their entities."""
    r = Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwzäéñ") for _ in range(r.randint(2, 9)))
    ascii_word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randint(2, 9)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def entity() -> tuple[str, str, str, str]:
        kind = r.choice(TYPES)
        if kind == "email":
            local = r.choice((ascii_word(), f"{ascii_word()}.{num(2)}", f"{ascii_word()}.{ascii_word()}", f"{ascii_word()}_{num(3)}", f"{ascii_word()}+{ascii_word()}", f"{ascii_word()}-{num(1)}", ".".join(ascii_word() for _ in range(r.randint(3, 9)))))
            return kind, f"{local}@{ascii_word()}{r.choice(('', num(1)))}.{r.choice(('com', 'org', 'net', 'example.com', 'co.uk', 'de'))}", "", ""
        if kind == "phone":
            a, b, c = num(3), num(3), num(4)
            return kind, r.choice((f"+{num(r.randint(1, 2))} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{num(2)} {a} {b} {c}", f"+{num(1)}-{a}-{b}-{c}", f"+{num(11)}")), "", ""
        if kind == "ip":
            if r.random() < 0.35:
                groups = ["".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4))) for _ in range(8)]
                return kind, r.choice((":".join(groups), "2001:" + ":".join(groups[:2]) + "::" + ":".join(groups[4 : r.randint(5, 7)]))), "", ""
            return kind, ".".join(str(r.randint(0, r.choice((9, 99, 255, 255)))) for _ in range(4)), "", ""
        if kind == "ssn":
            return kind, f"{num(3)}-{num(2)}-{num(4)}", "", ""
        if kind == "iban":
            x = "".join(r.choice("ABCDEFGHIKLNPRST") for _ in range(2)) + num(2) + r.choice(("", "".join(r.choice("ABCDEFGHKLMNPR") for _ in range(4)))) + num(r.randint(12, 20))
            return kind, r.choice((x, " ".join(x[k : k + 4] for k in range(0, len(x), 4)))), "", ""
        if kind == "card":
            x = r.choice("3456") + num(15)
            return kind, r.choice((x, x, " ".join(x[k : k + 4] for k in (0, 4, 8, 12)), "-".join(x[k : k + 4] for k in (0, 4, 8, 12)))), "", ""
        if r.random() < 0.3:
            return kind, "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), "", ""
        letters = lambda of, least, most: "".join(r.choice(of) for _ in range(r.randint(least, most)))
        if r.random() < 0.3:
            key = r.choice(("token", "password", "secret", "api_key", "key", "pwd"))
            return kind, letters("abcdefghijklmnopqrstuvwxyz", 6, 18), *r.choice(((f'{key} = "', '"'), (f'{key}="', '"'), (f"{key}=", ""), (f"{key}:", "")))
        if r.random() < 0.25:
            return kind, "".join(letters("abcdefghijklmnopqrstuvwxyz", 1, 2) + letters("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1, 2) for _ in range(r.randint(8, 14))), *r.choice((("token=", ""), ('key = "', '"'), ("", "")))
        value = "".join(r.choice("0123456789abcdef") for _ in range(r.choice((16, 18, 24, 32, 40, 64)))) + "7"
        name = r.choice(("token", "password", "secret", "api_key", "key", "pwd"))
        return kind, value, *r.choice(((f'{name} = "', '"'), (f"{name}=", ""), (f"{name}: ", ""), ("", "")))

    def other() -> str:
        return r.choice((
            f"{num(2)}:{num(2)}:{num(2)}", f"{num(1)}:{num(2)}:{num(2)}:{num(2)}", f"{ascii_word()}::{ascii_word()}{num(1)}", f"{num(2)}-{num(2)}-{num(4)}", f"{''.join(r.choice('ABCDEFGH') for _ in range(2))}{num(2)} {num(4)}", f"{''.join(r.choice('ABCDEFGH') for _ in range(2))}{num(6)}",
            f"{num(1)}.{num(1)}", f"{num(1)}.{num(1)}.", f"v{num(1)}.{num(2)}.{num(1)}", f"{num(1)}.{num(1)}.{num(1)}.{num(3)}{num(1)}", f"19{num(2)}", f"20{num(2)}-0{num(1)}-1{num(1)}", f"1{num(1)}:3{num(1)}", f"${num(3)}.{num(2)}", f"{num(2)}%", num(r.randint(1, 8)), f"{num(1)},{num(3)},{num(3)}",
            f"{num(3)}-{num(2)}", f"#{num(5)}", f"{num(2)}.{num(2)}.{num(4)}", f"{ascii_word()}{num(2)}", f"@{ascii_word()}", f"{ascii_word()} @ {num(2)}", f"({num(4)})", f"[{num(2)}]", f"http://{ascii_word()}.com/{num(3)}", f"3{num(2)}.{num(3)}.{num(3)}.9{num(2)}", num(24), f"{num(3)} {num(3)}", f"ISBN {num(9)}", f"{num(4)}/{num(4)}", f"{num(2)}th", ascii_word().upper(), "".join(r.choice("AEINORST") for _ in range(r.randint(16, 24))),
            f"{r.choice(('key', 'token', 'password', 'secret'))}: {word()}", "".join(ascii_word().capitalize() for _ in range(5)),
        ))

    out = []
    for _ in range(n):
        text, marks = "", []
        junk = r.random() < 0.2
        for _ in range(r.randint(4, 14)):
            p = r.random()
            if p < 0.16:
                kind, value, head, foot = entity()
                text += head
                marks.append((len(text), len(text) + len(value), kind))
                text += value + foot
                if r.random() < 0.15 and not foot and not (value.isalpha() and value.islower()):
                    text += " "
                    marks.append((len(text), len(text) + len(value), kind))
                    text += value
            elif p < 0.32:
                text += other()
            else:
                text += r.choice((word(), word(), word().capitalize(), f"{word()}.", f"{word()},", "token", "password", "key"))
            text += r.choice(("***", "%%%", "###", "&&&", "$$$", "!!", " |")) if junk else r.choice(("", "", "", ",", "."))
            text += r.choice((" ", " ", " ", " ", " ", "\n"))
        out.append((text, marks))
    return out


@lru_cache(maxsize=2)
def fit(n: int = 800, rounds: int = 120, seed: int = 5) -> np.ndarray:
    """Weights (features x types), by Adam on the log likelihood of the made sentences."""
    made = examples(n, seed)
    data, offs = utf8(pa.array([t for t, _ in made]))
    a = Atoms(data, line_borders(data, offs))
    i, length = segments(a)
    x = describe(a, i, length)
    text = np.searchsorted(offs, a.begin, "right") - 1
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    place = {(o, int(chars[s] - chars[offs[o]]), int(chars[e] - chars[offs[o]])): k for k, (o, s, e) in enumerate(zip(text[i].tolist(), a.begin[i].tolist(), a.end[i + length - 1].tolist()))}
    truth = np.zeros((len(i), len(TYPES)), np.float32)
    for o, (_, marks) in enumerate(made):
        for s, e, kind in marks:
            truth[place[o, s, e], TYPES.index(kind)] = 1
    w, m, v = np.zeros((x.shape[1], len(TYPES))), 0.0, 0.0
    w[0] = -3
    for step in range(1, rounds + 1):
        p = _posterior(a, i, length, (x @ w.astype(np.float32)).astype(np.float64))
        g = (x.T @ (truth - p.astype(np.float32))) / n - 2e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


_JOINS = np.isin(np.arange(256), np.frombuffer(b".@-_+%", np.uint8))


def long_addresses(a: Atoms, first: np.ndarray, n: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entities with every address of more than ``MOST`` atoms as a whole, in the place of whatever was found in it: touching words, dots and the like around a single ``@``, with a domain after it."""
    if not len(a.begin):
        return first, n, kind
    part = a.word | _JOINS[a.first]
    new = np.concatenate(([True], ~(part[1:] & part[:-1] & (a.gap[1 : len(part)] == 0))))
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(part)))
    for s, m in zip(begin[size > MOST].tolist(), size[size > MOST].tolist()):
        inner = np.arange(s, s + m)[a.word[s : s + m]]
        s, e = int(inner[0]), int(inner[-1]) + 1
        at = s + np.flatnonzero(a.first[s:e] == 64)
        if e - s > MOST and len(at) == 1 and (a.first[at[0] : e] == 46).any() and a.alpha[e - 1] and a.size[e - 1] >= 2:
            apart = (first + n <= s) | (first >= e)
            first, n, kind = np.append(first[apart], s), np.append(n[apart], e - s), np.append(kind[apart], TYPES.index("email"))
    order = np.argsort(first, kind="stable")
    return first[order], n[order], kind[order]


def scores(a: Atoms, i: np.ndarray, length: np.ndarray, weights: np.ndarray, block: int = 100_000) -> np.ndarray:
    """Scores of segments by type, a block at a time: the features of all at once would be many times the text."""
    w = weights.astype(np.float32)
    return np.concatenate([np.zeros((0, w.shape[1])), *(describe(a, i[s : s + block], length[s : s + block]) @ w for s in range(0, len(i), block))])


def key_places(data: np.ndarray) -> np.ndarray:
    text, out = data.tobytes().lower(), []
    for word in _KEYS:
        at = text.find(word)
        while at >= 0:
            out.append(at)
            at = text.find(word, at + 1)
    return np.array(out, np.int64)


def find(column: pa.Array, weights: np.ndarray, group_bytes: int = 128 << 10) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, begin and end in characters, and type number of each entity.

    Lines without a digit, ``@``, 16 capitals, a capital after a small letter, or a key word and a sign that tells its value can't hold one and are passed over; the others are decoded in groups of about ``group_bytes``.
    """
    data, offs = utf8(column)
    capital = (data >= 65) & (data < 91)
    for n in (1, 2, 4, 8):
        capital = capital[n:] & capital[:-n]
    borders = line_borders(data, offs)
    line = lambda at: np.unique(np.searchsorted(borders, at, "right") - 1)
    turns = np.flatnonzero((data[:-1] >= 97) & (data[:-1] < 123) & (data[1:] >= 65) & (data[1:] < 91))
    told = np.intersect1d(line(key_places(data)), line(np.flatnonzero(np.isin(data, _TELLS))))
    lines = np.union1d(line(np.concatenate((np.flatnonzero(_TRIGGER[data]), np.flatnonzero(capital), turns))), told)
    out = [np.zeros((3, 0), np.int64)]
    size = borders[lines + 1] - borders[lines] if len(lines) else lines
    group = np.cumsum(size) // group_bytes
    for g in np.unique(group):
        some, count = lines[group == g], size[group == g]
        own = np.concatenate(([0], np.cumsum(count)))
        part = data[np.arange(own[-1]) + np.repeat(borders[some] - own[:-1], count)]
        a = Atoms(part, own)
        i, length = segments(a)
        first, n, kind = long_addresses(a, *decode(a, i, length, scores(a, i, length, weights)))
        back = borders[some][a.owner[first]] - own[a.owner[first]]
        out.append(np.stack((a.begin[first] + back, a.end[first + n - 1] + back, kind)))
    begin, end, kind = np.concatenate(out, axis=1)
    row = np.searchsorted(offs, begin, "right") - 1
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return row, chars[begin] - chars[offs[row]], chars[end] - chars[offs[row]], kind


_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("type", pa.string())])


def find_pii(documents: DataFrame) -> DataFrame:
    """(doc_id, start, end, type) of each entity; start and end count characters from 0, end excluded; type is one of ``TYPES``.

    Entities lie within a line and have up to ``MOST`` atoms (words and signs), but for addresses, which may be of any length. Entities of one text don't overlap.
    Null and empty texts have none. Texts of any length are read whole. Repeated rows give repeated entities; null ids are carried.
    Empty tables give no rows. Other columns are ignored. One pass, no shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(fit())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(TYPES)
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                row, begin, end, kind = find(part.column("text"), shared.value)
                if len(row):
                    yield table(_OUT, part.column("doc_id").take(pa.array(row)), begin, end, names[kind].tolist())

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, start bigint, end bigint, type string")
