"""A small table of bits that tells, within an expression, which keys cannot be among a set.

The table is made by aggregation, its size is fixed by the number of bits, and it becomes one literal of the plan
(`KeyFilter`, for few keys or within a lambda) or a broadcast table (`KeyTable`), so rows that cannot match are dropped before they are exploded or shuffled. It lets some through that
are not in the set: what follows must still compare keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.session import saved

#: Bits a key, and bits of the largest table as a power of two (8 MB). Two million keys get all of their bits; with ten
#: million one key in seven passes that is not among them.
PER_KEY, MOST = 32, 26
_WORD = 6
#: Words of a block, as a power of two: the table is put together block by block.
_BLOCK = 10


def _table_bits(n: int, most: int) -> int:
    return min((max(n * PER_KEY, 1 << 10) - 1).bit_length(), most)


def _slot(value: Column, bits: int) -> Column:
    return value.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def _words(keys: DataFrame, col: str, bits: int) -> DataFrame:
    """(at, word): the words of the table that hold a bit."""
    return (keys.select(_slot(F.col(col), bits).alias("slot")).groupBy(F.shiftright("slot", _WORD).alias("at"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("slot") % (1 << _WORD)).cast("int"))).alias("word")))


def _is_set(table: Column, value: Column, bits: int) -> Column:
    slot = _slot(value, bits)
    word = F.get(table, F.shiftright(slot, _WORD).cast("int"))
    return F.getbit(word, (slot % (1 << _WORD)).cast("int")) == 1


class KeyFilter:
    """Bits of the `col` values (bigint hashes) of `keys`, about `n` rows."""

    def __init__(self, keys: DataFrame, col: str, n: int, most: int = MOST) -> None:
        self.bits = _table_bits(n, most)
        words = [0] * (1 << (self.bits - _WORD))
        for row in _words(keys, col, self.bits).collect():
            words[row["at"]] = row["word"]
        # Split and cast are folded, so the plan holds one array.
        self.table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")

    def may_hold(self, value: Column) -> Column:
        return _is_set(self.table, value, self.bits)


class KeyTable:
    """The same bits as a written table of one row, which is broadcast: no plan holds them. Of a literal in a plan Spark
    keeps, logs and prints a dozen copies on the driver, at 8 MB of bits some 20 MB of text each."""

    def __init__(self, keys: DataFrame, col: str, n: int, most: int = MOST) -> None:
        self.bits = _table_bits(n, most)
        zeros = keys.sparkSession.range(1 << (self.bits - _WORD)).select(F.col("id").alias("at"), F.lit(0).cast("bigint").alias("word"))
        full = _words(keys, col, self.bits).unionByName(zeros).groupBy("at").agg(F.bit_or("word").alias("word"))
        self.table = saved(_in_order(_in_order(full, F.shiftright("at", _BLOCK), "at", F.array("word")), F.lit(0), "at", F.col("word"))
                           .select(F.col("word").alias("_table")), "key-table")

    def may_hold(self, rows: DataFrame, value: Column) -> DataFrame:
        """Rows whose `value` may be among the keys."""
        return rows.join(F.broadcast(self.table), _is_set(F.col("_table"), value, self.bits), "left_semi")

    def holds_not(self, rows: DataFrame, value: Column) -> DataFrame:
        """The other rows."""
        return rows.join(F.broadcast(self.table), _is_set(F.col("_table"), value, self.bits), "left_anti")


def _in_order(rows: DataFrame, block: Column, order: str, words: Column) -> DataFrame:
    """(at, word): the arrays `words` of each block one after the other, by `order`."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), words.alias("word"))))
    return rows.groupBy(block.cast("bigint").alias("at")).agg(F.flatten(F.transform(parts, lambda p: p["word"])).alias("word"))
