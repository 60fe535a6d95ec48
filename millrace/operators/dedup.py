"""Exact and MinHash near-duplicate removal."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.components import connect
from millrace.session import scratched, settle

# Fixed values.
PRIME = (1 << 61) - 1
SEED = 0xC0DECAFE
SHINGLE = 5
THRESHOLD, HASHES, BANDS = 0.85, 128, 32


def digest(text: Column) -> Column:
    return F.coalesce(F.sha2(text.cast("binary"), 256), F.lit(""))


def exact_dedup(df: DataFrame, text: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): of rows with equal text, the one with the lowest seq stays.

    Null texts are equal to each other. A null seq comes after all others; of several rows with
    the lowest seq one stays. The map side keeps one seq per digest, and rows are
    dealt by digest and seq together, so a text that a third of the rows share does not fill a
    task.
    """
    own = df.withColumn("_digest", digest(F.col(text)))
    first = own.groupBy("_digest").agg(F.min(F.struct(F.col(seq).isNull().alias("none"), F.col(seq).alias("seq"))).alias("_f"))
    first = first.select(F.col("_digest").alias("_d"), F.col("_f.seq").alias("_s"), F.lit(True).alias("_lowest"))
    joined = own.join(first, (F.col("_digest") == F.col("_d")) & F.col(seq).eqNullSafe(F.col("_s")), "left")
    # the same choice in both results: by a hash of the row
    plain = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    again = F.row_number().over(Window.partitionBy("_digest", seq).orderBy(F.xxhash64(*plain)))
    stays = F.coalesce(F.col("_lowest"), F.lit(False)) & (F.col("_again") == 1)
    marked = joined.withColumn("_again", again)
    return marked.where(stays).select(*df.columns), marked.where(~stays).select(*df.columns)


@cache
def hash_pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The universal hash functions' (a, b), from a seeded generator."""
    rng = random.Random(SEED)
    pairs = [(rng.randint(1, PRIME - 1), rng.randint(0, PRIME - 1)) for _ in range(n)]
    return tuple(np.array(x, np.uint64) for x in zip(*pairs, strict=True))


def _fold(v: np.ndarray) -> np.ndarray:
    return (v & np.uint64(PRIME)) + (v >> np.uint64(61))


#: Distinct shingles whose hash values a task holds at once, HASHES values each.
VOCABULARY = 1 << 15


def _values(grams: list[str], n: int) -> np.ndarray:
    """Of each shingle's 32-bit hash h, the n values (a * h + b) mod PRIME. The product has up to 93 bits; it is folded modulo 2 ** 61 - 1 in halves of a."""
    h = np.array([int.from_bytes(hashlib.sha1(g.encode("utf-8", "surrogatepass")).digest()[:4], "big") for g in grams], np.uint64)
    a, b = hash_pairs(n)
    out = np.empty((len(h), n), np.uint64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096][:, None]
        high = _fold((a >> np.uint64(32))[None, :] * part)
        high = (high >> np.uint64(29)) + ((high & np.uint64((1 << 29) - 1)) << np.uint64(32))
        low = _fold((a & np.uint64(0xFFFFFFFF))[None, :] * part)
        v = _fold(_fold(_fold(high + low) + b[None, :]))
        out[at : at + 4096] = np.where(v >= np.uint64(PRIME), v - np.uint64(PRIME), v)
    return out


def _grams(text: str) -> set[str]:
    return {text[i : i + SHINGLE] for i in range(max(1, len(text) - SHINGLE + 1))}


#: Characters of texts that a task cuts into shingles at once.
GRAMS_HELD = 1 << 19


def _keys(text: str) -> np.ndarray | None:
    """The different shingles of a text, each as its five code points of 12 bits; None where that does not hold them."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(codes) < SHINGLE or codes.max() >= 1 << 12:
        return None
    n = len(codes) - SHINGLE + 1
    keys = codes[:n].copy()
    for k in range(1, SHINGLE):
        keys <<= 12
        keys |= codes[k : k + n]
    return np.unique(keys)


def _hashes_of(keys: np.ndarray) -> np.ndarray:
    """The 32-bit hash of each packed shingle."""
    codes = np.stack([keys >> 12 * (SHINGLE - 1 - k) & 0xFFF for k in range(SHINGLE)], 1).astype(np.uint32)
    chars = codes.tobytes().decode("utf-32-le", "surrogatepass")
    heads = b"".join(hashlib.sha1(chars[i : i + SHINGLE].encode("utf-8", "surrogatepass")).digest()[:4] for i in range(0, len(chars), SHINGLE))
    return np.frombuffer(heads, ">u4").astype(np.uint64)


def _hash(gram: str) -> int:
    return int.from_bytes(hashlib.sha1(gram.encode("utf-8", "surrogatepass")).digest()[:4], "big")


def _cut(texts: Iterator[str | None]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(number of texts, hashes of the different shingles of all, and for each text which of them it has), some GRAMS_HELD characters at a time."""

    def cut(keys: list[np.ndarray | None], odd: dict[int, set[str]]) -> tuple[int, np.ndarray, list[np.ndarray]]:
        packed = [k for k in keys if k is not None]
        every, at = np.unique(np.concatenate([np.zeros(0, np.int64), *packed]), return_inverse=True)
        number = {g: len(every) + i for i, g in enumerate(dict.fromkeys(g for grams in odd.values() for g in grams))}
        hashes = np.concatenate([_hashes_of(every), np.array([_hash(g) for g in number], np.uint64)])
        parts = iter(np.split(at, np.cumsum([len(k) for k in packed])[:-1]) if packed else [])
        return len(keys), hashes, [next(parts) if k is not None else np.array([number[g] for g in odd[i]], np.int64) for i, k in enumerate(keys)]

    keys, odd, size = [], {}, 0
    for t in texts:
        own = _keys(t) if t else None
        if own is None:
            odd[len(keys)] = _grams(t) if t else set()
        keys.append(own)
        size += len(t or "")
        if size >= GRAMS_HELD:
            yield cut(keys, odd)
            keys, odd, size = [], {}, 0
    if keys:
        yield cut(keys, odd)


def shingle_hashes(df: DataFrame, key: str, text: str, out: str = "hashes") -> DataFrame:
    """(key, hashes): the 32-bit hash of each different shingle of a text, ascending; null and empty texts have none.

    In Arrow batches, of which a task holds the shingles of some GRAMS_HELD characters at once,
    however many rows a batch has; each different shingle of these is digested once.
    """
    own = df.select(key, F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for n, hashes, each in _cut(t.as_py() for t in batch.column("_text")):
                lists = [np.sort(hashes[at]) for at in each]
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), flat], names=[key, out])
                start += n

    return own.mapInArrow(run, f"`{key}` {own.schema[key].dataType.simpleString()}, `{out}` array<bigint>")


def signature(text: str | None, n: int = HASHES) -> np.ndarray:
    """Per hash function the least value over the shingles' 32-bit hashes; PRIME for an empty text."""
    out = np.full(n, PRIME, np.uint64)
    grams = list(_grams(text)) if text else []
    for at in range(0, len(grams), VOCABULARY):
        out = np.minimum(out, _values(grams[at : at + VOCABULARY], n).min(0))
    return out.astype(np.int64)


#: Of each hash function the least values of a slice that are looked up, about; texts with fewer shingles are not looked up.
LEAST, FEW = 512, 64


def _columns(h: np.ndarray, n: int) -> np.ndarray:
    """``_values`` of 32-bit hashes, one row a hash function."""
    out = np.empty((n, len(h)), np.uint64)
    low29, prime = np.uint64((1 << 29) - 1), np.uint64(PRIME)
    for at in range(0, len(h), 8192):
        part = h[at : at + 8192]
        for j, (a, b) in enumerate(zip(*hash_pairs(n), strict=True)):
            # a product of up to 93 bits, folded in halves of a
            high = _fold((a >> np.uint64(32)) * part)
            v = _fold(_fold(_fold((high >> np.uint64(29)) + ((high & low29) << np.uint64(32)) + _fold((a & np.uint64(0xFFFFFFFF)) * part)) + b))
            # values of PRIME and more wrap to the least where it is taken from them
            out[j, at : at + 8192] = np.minimum(v, v - prime)
    return out


def _least(columns: np.ndarray, each: list[np.ndarray]) -> np.ndarray:
    """Of each text the least value of every hash function over its shingles.

    A text with many of the slice's shingles has one of the few that are least of all: those are
    gone through in order, and all its shingles only where none of them is its own.
    """
    n, m = columns.shape
    out = np.full((len(each), n), PRIME, np.uint64)
    if not m:
        return out
    bound = np.uint64(min(PRIME, PRIME * LEAST // m))
    first = [np.flatnonzero(c <= bound) for c in columns]
    first = [at[np.argsort(c[at])] for c, at in zip(columns, first, strict=True)]
    order = np.full((n, max(map(len, first))), m)
    for j, at in enumerate(first):
        order[j, : len(at)] = at
    here, rows = np.zeros(m + 1, bool), np.arange(n)
    for i, at in enumerate(each):
        if len(at) <= FEW or not order.shape[1]:
            if len(at):
                out[i] = columns[:, at].min(1)
            continue
        here[at] = True
        found = here[order[:, : 8 * m // len(at) + 8]]
        where = found.argmax(1)
        hit = found[rows, where]
        out[i, hit] = columns[rows[hit], order[rows[hit], where[hit]]]
        for j in np.flatnonzero(~hit):
            out[i, j] = columns[j, at].min()
        here[at] = False
    return out


def signatures(df: DataFrame, key: str, text: str, n: int = HASHES) -> DataFrame:
    """(key, signature). Arrow batches; shingles of some GRAMS_HELD characters are hashed at once, each different one once."""
    own = df.select(key, F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for rows, hashes, each in _cut(t.as_py() for t in batch.column("_text")):
                flat = _least(_columns(hashes, n), each).astype(np.int64).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * n), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, rows), lists], names=[key, "signature"])
                start += rows

    return own.mapInArrow(run, f"`{key}` {own.schema[key].dataType.simpleString()}, signature array<bigint>")


def estimated_jaccard(a: Column, b: Column) -> Column:
    """The share of equal slots; 0 for empty or unlike signatures."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), lambda e: e == 1))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)), F.lit(0.0)).otherwise(same / F.size(a))


def needed_bands(threshold: float, n: int, bands: int) -> int:
    """Bands that suffice: each unequal slot of a qualifying pair spoils one band at most."""
    unequal = n - int(np.ceil(n * threshold - 1e-9))
    return min(bands, unequal + 1)


def band_ends(threshold: float, n: int, bands: int) -> list[tuple[int, int]]:
    """The slots of each band that is looked at. Where the needed ones suffice, they are as wide as the signature lets them be,
    so that fewer unlike rows meet; otherwise all bands are taken as they are."""
    needed = needed_bands(threshold, n, bands)
    whole = n - int(np.ceil(n * threshold - 1e-9)) + 1 <= bands
    return [(i * n // needed, (i + 1) * n // needed) if whole else (i * n // bands, (i + 1) * n // bands) for i in range(needed)]


@scratched
def lsh_dedup(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD, n: int = HASHES, bands: int = BANDS) -> DataFrame:
    """(key, component) of every row: the lowest key of its near-duplicate cluster, whose holder survives.

    Two rows link when a band agrees and the estimated similarity reaches the threshold;
    clusters are the transitive closure. Equal texts have equal signatures, so they share one
    entry per band. Groups are not expanded into pairs: leaders first, then what they leave apart.
    """
    if n % bands:
        raise ValueError("the number of hashes must be a multiple of the number of bands")
    signed = signatures(df, key, text, n)
    # a signature's digest of 128 bits stands for it where rows are grouped and joined
    same = F.unhex(F.md5(F.array_join(F.col("signature").cast("array<string>"), ",").cast("binary")))
    signed = settle(signed.withColumn("_s", same), "signatures")
    classes = settle(signed.groupBy("_s").agg(F.min(key).alias("_rep")), "signature-sets")
    cut = F.array(*[F.xxhash64(F.lit(i), F.slice("signature", a + 1, b - a)) for i, (a, b) in enumerate(band_ends(threshold, n, bands))])
    sketch = F.transform("signature", lambda v: (F.pmod(v, F.lit(256)) - 128).cast("tinyint"))
    own = signed.select(F.col(key).alias("set"), cut.alias("cut"), sketch.alias("sketch"))
    sets = settle(own.join(classes.select(F.col("_rep").alias("set")), "set", "left_semi"), "sketches")
    entries = sets.select("set", F.explode("cut").alias("entry"))
    several = entries.groupBy("entry").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("entry")
    groups = settle(entries.join(several, "entry", "left_semi"), "bands")

    def alike(pairs: DataFrame, of: DataFrame, name: str, what: str) -> DataFrame:
        left, right = (of.select(F.col(name).alias(c), F.col(what).alias(f"_{c}")) for c in ("a", "b"))
        return pairs.join(left, "a").join(right, "b").where(estimated_jaccard(F.col("_a"), F.col("_b")) >= threshold).select("a", "b")

    def verify(pairs: DataFrame) -> DataFrame:
        # slots that are equal are equal in the sketch; few pairs pass it that do not link
        return alike(settle(alike(pairs, sets, "set", "sketch"), "near"), signed, key, "signature")

    labels = connect(groups, verify)
    named = classes.join(labels, classes["_rep"] == labels["node"], "left").select(F.col("_s").alias("_of"), F.coalesce("component", "_rep").alias("component"))
    return signed.select(key, "_s").join(named, F.col("_s") == F.col("_of")).select(key, "component")


def report(total: DataFrame, after_exact: DataFrame, after_near: DataFrame) -> DataFrame:
    """One row: total, exact, near, retained, dedup_rate."""
    counts = [d.agg(F.count(F.lit(1)).alias(n)) for d, n in ((total, "total"), (after_exact, "unique"), (after_near, "retained"))]
    one = counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # three single rows
    exact, near = F.col("total") - F.col("unique"), F.col("unique") - F.col("retained")
    rate = F.when(F.col("total") > 0, (exact + near) / F.col("total")).otherwise(F.lit(0.0))
    return one.select("total", exact.alias("exact"), near.alias("near"), "retained", rate.alias("dedup_rate"))
