"""URL verdicts by rules and by a list: a blocked Bloom filter in front of an exact hash join."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstat.llm.hashing import mixed
from rillstat.sinks.tables import stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bits of a block, one cache line; bits set per URL; bits per listed URL that are aimed at.
BLOCK_BITS = 512
PROBES = 6
BITS_PER_URL = 16

#: Blocks at most: 32 MB. A longer list makes the filter less sharp, never wrong.
MOST_BLOCKS = 1 << 19


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains and a start of the path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _after_scheme(url: str) -> Column:
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")


def host_of(url: str) -> Column:
    """What is between ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: str) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: str | Column, path: str | Column) -> Column:
    """One spelling of a page's address: no scheme, ``www.``, query, fragment, ``.html`` or slash at the end."""
    host, path = (F.col(x) if isinstance(x, str) else x for x in (host, path))
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(F.regexp_replace(path, r"\.html?$", ""), "/+$", ""))


def rule_for(rules: Sequence[Rule], host: str, path: str) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda rule: len(rule.text)):
        fits = ((F.col(host) == rule.host) | F.col(host).endswith(f".{rule.host}")) & F.col(path).startswith(rule.path)
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and its ``PROBES`` bits there."""
    block = (hashes >> np.uint64(40)) & np.uint64(blocks - 1)
    draw = mixed(hashes)
    bits = np.column_stack([(draw >> np.uint64(9 * i)) & np.uint64(BLOCK_BITS - 1) for i in range(PROBES)])
    return block.astype(np.int64), bits.astype(np.int64)


def blocked_bloom(listed: DataFrame, count: int) -> np.ndarray:
    """The filter of the 64-bit hashes in ``listed`` (``hash``): a table of blocks of bits.

    Tasks set the bits of their rows, which are put together by block and word before they come to
    the driver, at most ``MOST_BLOCKS`` blocks whatever the list holds.
    """
    wanted = max(1, count * BITS_PER_URL // BLOCK_BITS)
    blocks = min(1 << (wanted - 1).bit_length() if wanted > 1 else 1, MOST_BLOCKS)

    def spread(batches):
        for batch in batches:
            block, bits = _bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), blocks)
            word = np.repeat(block * (BLOCK_BITS // 64), PROBES) + (bits >> 6).ravel()
            held = np.zeros(blocks * (BLOCK_BITS // 64), dtype=np.uint64)
            np.bitwise_or.at(held, word, np.uint64(1) << (bits & 63).ravel().astype(np.uint64))
            some = np.unique(word)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some].view(np.int64))], names=["word", "bits"])

    words = listed.select("hash").mapInArrow(spread, "word BIGINT, bits BIGINT").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = words.toArrow()
    out = np.zeros((blocks, BLOCK_BITS // 64), dtype=np.uint64)
    out.ravel()[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return out


def may_be_listed(bloom: np.ndarray, hash: str) -> Column:
    """False for hashes that are surely not in the filter."""

    def look(hashes: pa.Array) -> pa.Array:
        block, bits = _bits(hashes.to_numpy(zero_copy_only=False).view(np.uint64), len(bloom))
        words = bloom[block[:, None], bits >> 6]
        return pa.array(((words >> (bits & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1))

    return F.arrow_udf(look, "boolean")(hash)


def judged(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], id: str = "page_id", url: str = "url") -> DataFrame:
    """``id, host, path, rule, verdict, listed`` for each row of ``pages``.

    ``listed`` has a column ``url`` of addresses to block, in any spelling. The longest rule that fits
    a page decides; else the page is blocked if its canonical address is listed. The filter lets
    possible hits through to a join on the whole address, so no page is blocked by chance.

    A null url or one without ``://`` has an empty host and path, no rule and is allowed; such and null addresses in the list
    count for nothing. Repeated pages come back as often as they are, repeated addresses of the list count once. Other columns are
    ignored. An empty table of pages gives an empty result, an empty list blocks nothing.
    """
    entries = listed.select(F.col("url").alias("_url"))
    entries = entries.select(canonical(host_of("_url"), path_of("_url")).alias("address")).filter("address <> ''").distinct()
    entries = stored(entries.withColumn("hash", F.xxhash64("address")), "listed")
    bloom = blocked_bloom(entries, entries.count())
    rows = pages.select(F.col(id).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("address", canonical("host", "path")).withColumn("hash", F.xxhash64("address"))
    rows = stored(rows.withColumn("possible", may_be_listed(bloom, "hash")), "pages")
    hits = rows.filter("possible").join(entries.select("address", F.lit(True).alias("listed")), "address", "left")
    columns = ["id", "host", "path", "listed"]
    every = hits.select(*columns).union(rows.filter("NOT possible").withColumn("listed", F.lit(False)).select(*columns))
    text, verdict = rule_for(rules, "host", "path")
    listed_ = F.coalesce("listed", F.lit(False))
    return every.select(
        F.col("id").alias(id), "host", "path", text.alias("rule"),
        F.coalesce(verdict, F.when(listed_, "block").otherwise("allow")).alias("verdict"),
        listed_.alias("listed"),
    )
