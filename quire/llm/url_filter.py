"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed one after another into words of 64 bits: a start bit for each rule and a bit for each of its
characters. One step of the automaton, for all rules at once, is a shift with carry, an AND with the mask of the next byte, and an OR with
those bits that wait at a ``*``. A rule matches if its last bit is set after the last byte. Many URLs go through it side by side.

In a rule ``*`` stands for any characters, also none and also slashes, ``?`` for exactly one; a rule must match the whole canonical URL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import slices, utf8

RULES = (
    "*://spam-farm.*", "*://*.spam-farm.*", "*://*cheap-pills.*", "*://*casino-*", "*://*free-bets.*", "*://ads-*", "*://*.doubleclick.*", "*://*/ads/*", "*://*/banner?/*",
    "*://*.xxx/*", "*://*torrent*", "*://*.onion/*", "*://*/login*", "*://*/wp-admin/*", "*://*/cgi-bin/*", "*.exe", "*.apk", "*.zip", "*://*/tag/*/page/*", "*://bit.ly/*", "*://*click*track*", "*sessionid=*", "*://*.example.org/??/666*", "*://m.*.example.net/fr/*",
)


def canonical(url: Column) -> Column:
    """No blanks around, no fragment, scheme and host in lower case, no user, no dot at the host's end, no default port, no ``.`` and ``..`` in the path, no ``utm_`` parameters, ``/`` for an empty path."""
    u = F.regexp_replace(F.regexp_replace(url, r"^\s+|\s+$", ""), r"#.*$", "")
    head = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0)
    tail = F.substring(u, F.length(head) + 1, F.length(u))
    host = F.regexp_replace(F.lower(head), r"://.*@", "://")
    host = F.regexp_replace(F.regexp_replace(host, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    host = F.regexp_replace(host, r"\.(:[0-9]*)?$", "$1")
    tail = F.regexp_replace(tail, r"([?&])utm_[^&]*", "$1")
    tail = F.regexp_replace(F.regexp_replace(F.regexp_replace(tail, r"&&+", "&"), r"\?&+", "?"), r"[?&]+$", "")
    tail = F.when((host != "") & ~tail.startswith("/"), F.concat(F.lit("/"), tail)).otherwise(tail)
    path = F.regexp_extract(tail, r"^[^?]*", 0)
    steps = F.split(path, "/")
    last = F.element_at(steps, -1)
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, x: F.when(x == ".", acc).when(x == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(x))))
    clean = F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))
    dotted = (host != "") & path.rlike(r"/\.\.?(/|$)")
    return F.concat(host, F.when(dotted, F.concat(clean, F.substring(tail, F.length(path) + 1, F.length(tail)))).otherwise(tail))


class Automaton:
    def __init__(self, rules: tuple[str, ...]) -> None:
        parsed = []
        for rule in rules:
            chars: list[tuple[bytes, bool]] = []
            waits = [False]
            for c in rule:
                if c == "*":
                    waits[-1] = True
                    continue
                for b in [None] if c == "?" else c.encode():
                    chars.append(b)
                    waits.append(False)
            parsed.append((chars, waits))
        n = sum(len(w) for _, w in parsed)
        self.words = max(1, -(-n // 64))
        bit = lambda i: (i >> 6, np.uint64(1) << np.uint64(i & 63))
        self.masks, self.start, self.wait, self.rest, self.final = np.zeros((256, self.words), np.uint64), *(np.zeros(self.words, np.uint64) for _ in range(3)), []
        at = 0
        for chars, waits in parsed:
            w, b = bit(at)
            self.start[w] |= b
            for i, c in enumerate(chars, 1):
                w, b = bit(at + i)
                if c is None:  # a character: its first byte, and then whatever bytes go on with it
                    self.masks[:0x80, w] |= b
                    self.masks[0xC0:, w] |= b
                    self.rest[w] |= b
                else:
                    self.masks[c, w] |= b
            for i, stay in enumerate(waits):
                if stay:
                    w, b = bit(at + i)
                    self.wait[w] |= b
            self.final.append(bit(at + len(chars)))
            at += len(waits)

    def run(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """(texts, rules): which match."""
        size = np.diff(offs)
        order = np.argsort(-size, kind="stable")
        begin, size = offs[:-1][order], size[order]
        state = np.tile(self.start, (len(order), 1))
        active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
        one, top = np.uint64(1), np.uint64(63)
        for t, m in enumerate(active):
            byte = data[begin[:m] + t]
            now = state[:m]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            moved &= self.masks[byte]
            moved |= now & self.wait
            going = (byte & 0xC0) == 0x80
            if going.any():
                moved[going] |= now[going] & self.rest
            state[:m] = moved
        out = np.empty((len(order), len(self.final)), bool)
        for r, (w, b) in enumerate(self.final):
            out[order, r] = state[:, w] & b != 0
        return out


def filter_urls(pages: DataFrame, rules: tuple[str, ...] = RULES) -> DataFrame:
    """(page_id, canonical, blocked, rules) for every row of ``pages``: whether a rule matches, and those that do, in their order, joined by spaces.

    A null URL stays null and is blocked by none; an empty one is tested as it is. URLs of any length are read whole. Repeated rows and
    null ids are treated like others. Empty pages give no rows; without rules nothing is blocked. Other columns are ignored.
    """
    rules = tuple(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, names = Automaton(rules), np.array([*rules, ""], object)
        for batch in batches:
            for part in slices(batch, "canonical"):
                url = part.column("canonical")
                hit = automaton.run(*utf8(url)) & ~np.asarray(url.is_null())[:, None]
                row, rule = np.nonzero(hit)
                said = [""] * part.num_rows
                for r, name in zip(row.tolist(), names[rule]):
                    said[r] = f"{said[r]} {name}" if said[r] else name
                yield pa.RecordBatch.from_arrays([part.column("page_id"), url, pa.array(hit.any(axis=1)), pa.array(said, pa.string())], names=["page_id", "canonical", "blocked", "rules"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), canonical(F.col("url").cast("string")).alias("canonical")).mapInArrow(run, "page_id bigint, canonical string, blocked boolean, rules string")
