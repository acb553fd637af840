"""Shards by jump consistent hash, with a gapless slot inside each shard. DataFrame functions only.

Method. The published jump hash: a linear congruential generator seeded by the key gives the
shard counts at which the key jumps; the last jump below the shard count is its shard. A shard
more takes rows only into itself. The generator's 64-bit product is made of 32-bit halves, so
that it is the same under ANSI arithmetic.

Slots. Rows are dealt to lots by the checksums of id and text, about LOT_ROWS to each, so neither
far ids nor many rows without id nor copies of one text make a lot large. Rows of a shard and lot
are numbered by one task, and a lot starts where the counts of those before it in its shard end:
no task gets a shard as a whole.

Defined results: ids are any 64-bit numbers; a null text has the size of its row alone and the
checksum of no bytes; a null id is hashed as 0; rows that repeat id and text are combined before
the shuffle and get slots of their own, one after another, written by several tasks if they are
more than COPIES; of an empty table nothing comes. Columns other than id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sprucelake.llm.common import written

#: Fixed values of the published algorithm.
MULTIPLIER = 2862933555777941757
SCALE = 1 << 31
#: Jumps tried before the whole range is walked: enough for all but about one key in a million.
JUMPS = 32
#: Rows of a lot, on average over all shards.
LOT_ROWS = 200_000
#: Copies of one row that a task numbers at most.
COPIES = 10_000

MASK = 0xFFFFFFFF


def _product32(half: Column, factor: int) -> Column:
    """half * factor modulo 2**32 for a half below 2**32, without leaving 63 bits."""
    low = half.bitwiseAND(0xFFFF) * factor
    high = (F.shiftright(half, 16) * factor).bitwiseAND(0xFFFF)
    return (low + F.shiftleft(high, 16)).bitwiseAND(F.lit(MASK))


def _next(key: Column) -> Column:
    """The generator's next state: key * MULTIPLIER + 1 modulo 2**64, as a signed long."""
    m_low, m_high = MULTIPLIER & MASK, MULTIPLIER >> 32
    low, high = key.bitwiseAND(F.lit(MASK)), F.shiftrightunsigned(key, 32)
    first, second = low.bitwiseAND(0xFFFF) * m_low, F.shiftright(low, 16) * m_low
    sum_ = first + F.shiftleft(second.bitwiseAND(0xFFFF), 16) + 1
    carry = F.shiftright(sum_, 32) + F.shiftright(second, 16)
    top = (carry + _product32(low, m_high) + _product32(high, m_low)).bitwiseAND(F.lit(MASK))
    return F.shiftleft(top, 32).bitwiseOR(sum_.bitwiseAND(F.lit(MASK)))


def jump_shards(key: Column, shards: int) -> Column:
    """(shard, grown) of a long key: its shard among `shards` and among one more."""
    grown = shards + 1

    def jump(state: Column, _: Column) -> Column:
        # at: the last jump below `shards`; to: the next jump; once to >= grown nothing changes
        key = _next(state["key"])
        go = state["to"] < grown
        draw = F.shiftrightunsigned(key, 33) + 1
        to = F.floor((state["to"] + 1) * (F.lit(float(SCALE)) / draw)).cast("long")
        return F.when(go, F.struct(F.when(state["to"] < shards, state["to"]).otherwise(state["at"]).alias("at"), state["to"].alias("grown"), to.alias("to"), key.alias("key"))).otherwise(state)

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("grown"), F.lit(0).cast("long").alias("to"), F.coalesce(key.cast("long"), F.lit(0).cast("long")).alias("key"))
    some = F.aggregate(F.sequence(F.lit(1), F.lit(min(JUMPS, grown + 1))), start, jump)
    if grown + 1 <= JUMPS:
        return some
    return F.when(some["to"] >= grown, some).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(grown + 1)), some, jump))


def shards_by_key(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + row_bytes).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    lots = max(1, math.ceil(docs.count() / LOT_ROWS))
    lot = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) + F.col("text_crc32"), F.lit(lots))
    once = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    put = once.withColumn("jump", jump_shards(F.col("doc_id"), shards)).select("doc_id", "size", "text_crc32", "copies", F.col("jump.at").cast("int").alias("shard"), F.col("jump.grown").cast("int").alias("grown_shard"), lot.alias("lot"))
    put = written(put, "put")  # read twice; the jumps are worked out once
    starts = put.groupBy("shard", "lot").agg(F.sum("copies").alias("n"))
    starts = starts.select("shard", "lot", (F.sum("n").over(W.partitionBy("shard").orderBy("lot")) - F.col("n")).alias("start"))
    inside = W.partitionBy("shard", "lot").orderBy("doc_id", "size", "text_crc32")
    placed = put.withColumn("before", F.sum("copies").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("copies")).join(starts, ["shard", "lot"])
    placed = placed.select("doc_id", "size", "text_crc32", "copies", "shard", "grown_shard", (F.col("start") + F.col("before")).alias("first"))
    first = F.lit(0).cast("long")
    if put.where(F.col("copies") > COPIES).limit(1).count():
        # Rows with very many copies are cut into blocks of copies before these are made.
        blocks = placed.withColumn("block", F.explode(F.sequence(first, F.floor((F.col("copies") - 1) / COPIES)))).repartition("doc_id", "size", "text_crc32", "block")
        each = blocks.withColumn("copy", F.explode(F.sequence(F.col("block") * COPIES, F.least(F.col("copies"), (F.col("block") + 1) * COPIES) - 1)))
    else:
        each = placed.withColumn("copy", F.explode(F.sequence(first, F.col("copies") - 1)))
    return each.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("copy")).alias("slot"), "grown_shard")


def sharding_sql(shards: int, row_bytes: int = 16) -> str:
    """DuckDB SQL for shards_by_key over documents: CRC-32 byte by byte, the generator in 128 bits."""
    crc = "list_reduce(list_prepend(4294967295::BIGINT, {}), lambda c, b: xor(c >> 8, t.v[(xor(c, b) & 255) + 1]))"
    octets = "list_transform(regexp_extract_all(hex(encode({})), '..'), lambda x: ('0x' || x)::BIGINT)"
    checksum = lambda text: f"xor({crc.format(octets.format(text))}, 4294967295)"
    entry = "list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"""
WITH RECURSIVE t AS (SELECT list({entry} ORDER BY i) AS v FROM range(256) r(i)),
d AS (SELECT doc_id, (strlen(coalesce(text, '')) + {row_bytes})::BIGINT AS size, {checksum("coalesce(text, '')")} AS text_crc32,
  {checksum("coalesce(doc_id::VARCHAR, '')")} AS id_crc32, greatest(1, ceil(count(*) OVER () / {LOT_ROWS}))::BIGINT AS lots FROM documents, t),
j AS (SELECT DISTINCT doc_id, ((coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616)::UHUGEINT AS k, -1::BIGINT AS was, 0::BIGINT AS nxt FROM documents
  UNION ALL SELECT doc_id, n AS k, nxt AS was, floor((nxt + 1) * ({float(SCALE)} / ((n >> 33)::DOUBLE + 1)))::BIGINT AS nxt
  FROM (SELECT *, (k * {MULTIPLIER}::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS n FROM j WHERE nxt <= {shards}) s),
h AS (SELECT doc_id, max(was) FILTER (was < {shards}) AS shard, max(was) AS grown FROM j GROUP BY doc_id)
SELECT d.doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, grown::INT AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY (id_crc32 + text_crc32) % lots, d.doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
FROM d JOIN h ON d.doc_id IS NOT DISTINCT FROM h.doc_id"""
