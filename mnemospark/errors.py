"""Coded errors."""

from __future__ import annotations

# The codes.
CONFIG, VECTOR_DIM, INVALID_QUERY = 1001, 1002, 1003
NOT_FOUND = 3001
IO, CLOSED, INVALID_MAGIC, CRC_MISMATCH, CORRUPTION, SERIALIZATION, DESERIALIZATION = range(5001, 5008)
ENCODER, LLM = 9001, 9002


class MemoryError_(Exception):
    """An error of the engine with a numeric code."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def code_of(error: BaseException) -> int:
    """The code of an error or of one of its causes, 0 if foreign."""
    while error is not None:
        if isinstance(error, MemoryError_):
            return error.code
        error = error.__cause__
    return 0
