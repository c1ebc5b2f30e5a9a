"""Statuses of a document's extraction: codes, names, and how an error is classified."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUS = {
    0: "SUCCESS", 1: "FAILURE_NOT_FOUND", 2: "FAILURE_UNREADABLE", 3: "FAILURE_NOT_DECRYPTED", 4: "FAILURE_NOT_PARSED",
    8: "FAILURE_UNKNOWN", 9: "FAILURE_NOT_SAVED", 10: "FAILURE_FATAL", 11: "FAILURE_TIMEOUT",
}
CODES = {name: code for code, name in STATUS.items()}
#: With these, a path isn't tried again.
FINAL = (CODES["SUCCESS"], CODES["FAILURE_TIMEOUT"], CODES["FAILURE_FATAL"])


def status_name(code: Column) -> Column:
    return F.element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in STATUS.items())), code.cast("int"))


def parse_status(text: Column) -> Column:
    """Code of a status given by number or by name; null if there is none such."""
    number = text.try_cast("int")
    by_name = F.element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in CODES.items())), F.upper(F.trim(text)))
    return F.when(number.isin(*STATUS), number).otherwise(by_name)


def classify(exception: Column, cause: Column, stage: Column) -> Column:
    """Code by the first rule that applies to (class, class of the cause, stage ``parse``, ``transform`` or ``save``).

    A missing file counts as not found under either of its names. Fatal are the errors of a virtual machine, and Python's for want of memory or stack; other classes that end in ``Error`` aren't.
    """
    is_ = lambda c, *names: F.coalesce(F.element_at(F.split(c, r"\."), -1).isin(*names), F.lit(False))
    either = lambda *names: is_(exception, *names) | is_(cause, *names)
    io = ("IOException", "FileNotFoundException", "NoSuchFileException", "AccessDeniedException", "EOFException", "TikaException", "EncryptedDocumentException", "ParseException", "OSError", "ZipException")
    code = lambda name: F.lit(CODES[name])
    return (
        F.when(exception.isNull(), code("SUCCESS"))
        .when(exception.rlike(r"^(java|javax|jdk|sun)\..*Error$") | is_(exception, "OutOfMemoryError", "StackOverflowError", "VirtualMachineError", "LinkageError", "NoClassDefFoundError", "InternalError", "MemoryError", "RecursionError"), code("FAILURE_FATAL"))
        .when(either("TimeoutException"), code("FAILURE_TIMEOUT"))
        .when(either("InterruptedException"), code("FAILURE_UNKNOWN"))
        .when(stage == "save", code("FAILURE_NOT_SAVED"))
        .when(stage == "transform", code("FAILURE_NOT_PARSED"))
        .when(either("FileNotFoundException", "NoSuchFileException"), code("FAILURE_NOT_FOUND"))
        .when(~is_(exception, *io), code("FAILURE_UNKNOWN"))
        .when(either("EncryptedDocumentException"), code("FAILURE_NOT_DECRYPTED"))
        .when(either("TikaException", "ParseException", "ZipException"), code("FAILURE_NOT_PARSED"))
        .otherwise(code("FAILURE_UNREADABLE"))
    )


def exception_summary(exception: Column, message: Column) -> Column:
    """Class and message; two reports with equal status and summary are equal."""
    return F.struct(exception.alias("exception_class"), message.alias("exception_message"))
