"""Time-ordered 63-bit ids: 39 bits of 10 ms ticks, 8 bits of sequence, 16 bits of machine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the ticks begin: 2023-09-01 00:00:00 UTC, in milliseconds.
EPOCH_MS = 1_693_526_400_000


def build(created_at: Column, sequence: Column, machine: Column) -> Column:
    ticks = F.floor((F.unix_millis(created_at) - EPOCH_MS) / 10).cast("long")
    return F.shiftleft(ticks, 24).bitwiseOR(F.shiftleft(sequence.cast("long"), 16)).bitwiseOR(machine.cast("long"))


def created_at(value: Column) -> Column:
    return F.timestamp_millis(F.shiftright(value, 24) * 10 + EPOCH_MS)


def machine(value: Column) -> Column:
    return value.bitwiseAND(F.lit(0xFFFF)).cast("int")
