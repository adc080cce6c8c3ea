"""Exact dedup: counting quotient filters per partition, merged without loss, then byte verification.

Texts are normalised by lower-casing A-Z. Each partition packs the 64-bit fingerprints of its texts into a counting
quotient filter for each block of quotients; the filters of a block merge by their sorted remainders. Only texts whose
fingerprint counts more than once are shuffled on to be compared byte by byte, so the shuffled text is bounded by
the text that can be a copy.

Null texts count as empty. Rows with a null id are counted in their group and reported with a null id; if a group
has no id at all its keep_id is null. Rows that repeat an id are one document: all of them are kept or dropped.
An empty table gives an empty result.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, stash

#: Texts of a fingerprint that counts more than HOT and more than a HOT_SHARE of all rows are dealt over SALTS tasks; so no more than 1 / HOT_SHARE fingerprints are sent to all.
SALTS, HOT, HOT_SHARE = 16, 5_000, 1e-5


class QuotientFilter:
    """Fingerprints of one block: sorted remainders, the length of the run of each quotient, and counts.

    A fingerprint is block | quotient | remainder from its highest to its lowest bits. Remainders of a run are
    sorted and unlike; a count is held for each.
    """

    def __init__(self, quotient_bits: int, low_bits: int, quotients, remainders, counts):
        self.q, self.low = quotient_bits, low_bits
        self.quotients, self.remainders, self.counts = quotients, remainders, counts

    @classmethod
    def build(cls, low: np.ndarray, quotient_bits: int, low_bits: int, counts: np.ndarray | None = None) -> "QuotientFilter":
        """low: the fingerprints' bits below those of the block."""
        if counts is None:
            low, counts = np.unique(low, return_counts=True)
        shift = np.uint64(low_bits - quotient_bits)
        runs = np.bincount((low >> shift).astype(np.int64), minlength=1 << quotient_bits).astype(np.uint32)
        return cls(quotient_bits, low_bits, runs, low & ((np.uint64(1) << shift) - np.uint64(1)), counts.astype(np.uint64))

    def fingerprints(self) -> np.ndarray:
        quotient = np.repeat(np.arange(len(self.quotients), dtype=np.uint64), self.quotients)
        return (quotient << np.uint64(self.low - self.q)) | self.remainders

    def merge(self, *others: "QuotientFilter") -> "QuotientFilter":
        """Sums the counts of equal remainders of equal quotients; no fingerprint is lost or mixed with another."""
        every = [self, *others]
        low = np.concatenate([x.fingerprints() for x in every])
        counts = np.concatenate([x.counts for x in every])
        low, at = np.unique(low, return_inverse=True)
        return QuotientFilter.build(low, self.q, self.low, np.bincount(at, weights=counts, minlength=len(low)))

    def pack(self) -> bytes:
        """Run lengths, remainders, then the places and values of counts over one."""
        many = np.flatnonzero(self.counts > 1).astype(np.uint32)
        head = np.array([self.q, self.low, len(self.remainders), len(many)], dtype=np.uint32)
        return b"".join(x.tobytes() for x in (head, self.quotients, self.remainders, many, self.counts[many]))

    @classmethod
    def unpack(cls, data: bytes) -> "QuotientFilter":
        q, low, n, m = (int(x) for x in np.frombuffer(data, np.uint32, 4))
        at = 16 + 4 * (1 << q)
        runs = np.frombuffer(data, np.uint32, 1 << q, 16)
        remainders = np.frombuffer(data, np.uint64, n, at)
        counts = np.ones(n, np.uint64)
        counts[np.frombuffer(data, np.uint32, m, at + 8 * n)] = np.frombuffer(data, np.uint64, m, at + 8 * n + 4 * m)
        return cls(q, low, runs, remainders, counts)


def normalised(df: DataFrame, with_text: bool) -> DataFrame:
    """doc_id, fp and either the digest or the bytes of the normalised text."""

    def run(batches):
        for b in batches:
            texts = [x.lower() for x in b.column("text").cast(pa.binary()).to_pylist()]
            fp = pa.array(np.array([xxhash.xxh3_64_intdigest(x) for x in texts], np.uint64).view(np.int64))
            last = pa.array(texts, pa.binary()) if with_text else pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), fp, last], ["doc_id", "fp", "norm" if with_text else "sha"])

    return df.mapInArrow(run, "doc_id long, fp long, " + ("norm binary" if with_text else "sha string"))


def repeated_fingerprints(fps: DataFrame, blocks: int, quotient_bits: int = 8) -> DataFrame:
    """fp, n: the fingerprints that occur more than once, and how often. blocks: a power of two."""
    block_bits = blocks.bit_length() - 1
    low_bits = 64 - block_bits

    def build(batches):
        held, n = [], 0

        def flush():
            fp = np.sort(np.concatenate(held))
            block = (fp >> np.uint64(low_bits)).astype(np.int64) if block_bits else np.zeros(len(fp), np.int64)
            cut = np.flatnonzero(np.diff(block)) + 1
            low = fp & ((np.uint64(1) << np.uint64(low_bits)) - np.uint64(1)) if block_bits else fp
            parts = np.split(low, cut)
            first = block[np.r_[0, cut]]
            return pa.RecordBatch.from_arrays(
                [pa.array(first.astype(np.int32)), pa.array([QuotientFilter.build(x, quotient_bits, low_bits).pack() for x in parts], pa.binary())], ["block", "filter"]
            )

        for b in batches:
            held.append(b.column("fp").to_numpy().view(np.uint64))
            n += b.num_rows
            if n >= 4_000_000:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def merge(key, table):
        first, *rest = [QuotientFilter.unpack(x) for x in table.column("filter").to_pylist()]
        whole = first.merge(*rest)
        block = np.uint64(key[0].as_py() << low_bits) if block_bits else np.uint64(0)
        many = whole.counts > 1
        fp = (whole.fingerprints()[many] | block).view(np.int64)
        return pa.table({"fp": pa.array(fp, pa.int64()), "n": pa.array(whole.counts[many].astype(np.int64), pa.int64())})

    return fps.select("fp").mapInArrow(build, "block int, filter binary").groupBy("block").applyInArrow(merge, "fp long, n long")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of df; the row with the largest id stays."""
    docs = id_text(df, id_col, text_col)
    ids = stash(normalised(docs, False), "fingerprints")
    rows = ids.count()
    blocks = 1 << min(16, max(4, (rows // 100_000).bit_length()))
    repeated = stash(repeated_fingerprints(ids, blocks), "repeated")
    is_hot = F.col("n") > max(HOT, int(rows * HOT_SHARE))
    salted = repeated.select("fp", F.explode(F.sequence(F.lit(0), F.when(is_hot, SALTS - 1).otherwise(0))).alias("salt"))
    hot = repeated.where(is_hot).select("fp", F.lit(True).alias("hot"))
    texts = normalised(docs, True).join(F.broadcast(hot), "fp", "left")
    texts = texts.withColumn("salt", F.when(F.col("hot"), F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(SALTS))).otherwise(0).cast("int"))
    same = texts.join(salted, ["fp", "salt"]).groupBy("fp", "salt", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    groups = (
        same.groupBy("fp", "norm")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        .where("n > 1")
        .select(F.sha2("norm", 256).alias("sha"), "keep_id", F.col("n").alias("size"), F.lit(True).alias("grouped"))
    )
    out = ids.join(groups, "sha", "left")
    keep = F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
