"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

The 5-word shingles of a text (A-Z and other letters lower-cased, words `[^\\x20\\x09-\\x0D]+`) are hashed once; the
top bits of a hash name its bin, each bin keeps its smallest hash. Sorting the hashes puts a bin's smallest first, so one sort and
one pass make the signature. Empty bins are filled by optimal densification: every bin has its own fixed pseudo-random sequence of
bins and copies the first one that isn't empty; after PROBES misses it copies the bin with the smallest hash of
(bin, candidate), which costs no more than there are candidates. Copies are hashed with their bin. The low 8 bits of each bin are packed into a hexadecimal string. likeness()
corrects the share of equal bins for those that are equal by chance.

Defined cases: null is the empty text; a text without words has the fingerprint '' (likeness 1 to another such, else 0); fewer words than a
shingle are one shingle; equal texts have equal fingerprints wherever they are computed. Columns of the input keep their names and values, but for
one named fingerprint, which is replaced. Documents of equal doc_id, or of none, are ordered by the hash of their text.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_BITS, LOW_BITS, SHINGLE, PROBES = 8, 8, 5, 12
BINS = 1 << BIN_BITS
LOWEST = -(2**63)
#: What helper columns of an output are named: it and these behind its name.
ENDS = ("", "_w", "_h", "_s", "_f", "_a")
#: Documents of one doc_id (or none) beyond a bucket's share are dealt by their text's hash to as many ranges.
RANGES = 64
#: Buckets a shuffle partition holds on average, so that partitions come out alike.
SPREAD = 64


def _bin(x: Column) -> Column:
    """0 to BINS - 1, ascending with the signed hash."""
    return F.shiftright(x, 64 - BIN_BITS).cast("int") + BINS // 2


def with_bins(rows: DataFrame, text: str, out: str) -> DataFrame:
    """rows with `out`: array<tinyint> of the low bits of each bin, empty for a text without words."""
    w, h, s, f, a = (f"{out}{end}" for end in ENDS[1:])
    plain = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    rows = rows.withColumn(w, F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, r"[\x20\x09-\x0D]+")))
    rows = rows.withColumn(h, F.transform(w, lambda x: F.xxhash64(x))).drop(w)
    windows = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*(F.get(F.col(h), i + j) for j in range(SHINGLE))))
    rows = rows.withColumn(s, F.when(F.size(h) >= SHINGLE, windows).when(F.size(h) > 0, F.array(F.xxhash64(F.col(h), F.size(h)))).otherwise(F.array().cast("array<bigint>"))).drop(h)
    rows = rows.withColumn(s, F.sort_array(s))
    rows = rows.withColumn(f, F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(F.col(s), i - 1))))).drop(s)
    nulls = lambda n: F.array_repeat(F.lit(None).cast("bigint"), n)
    gaps = F.flatten(F.transform(f, lambda x, i: F.concat(F.array(x), nulls(F.coalesce(_bin(F.get(F.col(f), i + 1)), F.lit(BINS)) - _bin(x) - 1))))
    rows = rows.withColumn(a, F.when(F.size(f) == BINS, F.col(f)).when(F.size(f) > 0, F.concat(nulls(_bin(F.get(F.col(f), F.lit(0)))), gaps)))
    rng = random.Random(20)
    probes = [F.lit([rng.randrange(BINS) for _ in range(BINS)]) for _ in range(PROBES)]

    def filled(x: Column, b: Column) -> Column:
        least = F.array_min(F.transform(f, lambda y: F.struct(F.xxhash64(b, _bin(y)).alias("order"), y.alias("value"))))
        donor = F.coalesce(*(F.get(F.col(a), F.get(p, b)) for p in probes), least["value"])
        return F.coalesce(x, F.xxhash64(donor, b))  # hashed again, so that chance hits of a donor don't repeat

    low = lambda x: (x.bitwiseAND(F.lit((1 << LOW_BITS) - 1)) - 128).cast("tinyint")  # noqa: E731  0 to 255 as -128 to 127
    full = F.transform(a, lambda x: low(x))
    rows = rows.withColumn(out, F.when(F.size(f) == 0, F.array().cast("array<tinyint>")).when(F.size(f) == BINS, full).otherwise(F.transform(a, lambda x, b: low(filled(x, b)))))
    return rows.drop(f, a)


def packed(bins: str) -> Column:
    """The bins as hexadecimal digits."""
    digits = F.lit([f"{i:02x}" for i in range(256)])
    return F.array_join(F.transform(bins, lambda x: F.get(digits, x.cast("int") + 128)), "")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard likeness of two arrays of bins, corrected for bins that are equal by chance; 0 to 1."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)).cast("double") / BINS
    chance = 1.0 / (1 << LOW_BITS)
    known = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(known)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with fingerprint."""
    rows = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() != "fingerprint"))
    taken, bins = {c.lower() for c in rows.columns}, "bins"
    while taken & {f"{bins}{end}" for end in ENDS}:
        bins = f"_{bins}"
    return with_bins(rows, "text", bins).withColumn("fingerprint", packed(bins)).drop(bins)


def _buckets(kids: DataFrame, most: int) -> Column:
    """A bucket number that ascends with (kid, th): SPREAD for each shuffle partition and `most` ** 3 in all at most. At most `most` ** 2 ranges of kids lie between
    approximate quantiles and are found in two steps; where more buckets are due, each range is cut evenly into as many as `most`. A kid that fills ranges alone,
    as several quantiles are equal, has RANGES of its own by th."""
    due = SPREAD * int(kids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, finer = min(most * most, due), min(most, -(-due // (most * most)))
    found = kids.agg(F.percentile_approx("kid", [i / n for i in range(1, n)], 100 * n).alias("q")).first()["q"] or []
    cuts = sorted(set(found)) or [LOWEST]
    uppers = [*cuts[1:], cuts[-1]]
    groups = [slice(i, i + most) for i in range(0, len(cuts), most)]
    coarse = F.size(F.filter(F.lit([cuts[g][0] for g in groups]), lambda x: x <= F.col("kid")))
    of_group = lambda values: F.get(F.array(*(F.lit(values[g]) for g in groups)), coarse - 1)
    fine = F.size(F.filter(of_group(cuts), lambda x: x <= F.col("kid")))
    bucket = F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * most + fine)
    hot = [k for k in cuts if found.count(k) > 1]
    #: The bucket that begins with a hot kid has its rows of that kid first, then the others.
    within = F.when(F.col("kid").isin(hot), F.floor((F.col("th").cast("double") / 2.0**64 + 0.5) * (RANGES - 1))).otherwise(F.lit(RANGES)) if hot else F.lit(0)
    bucket = bucket * (RANGES + 1) + within
    if finer > 1:
        low, high = (F.get(of_group(values), fine - 1).cast("double") for values in (cuts, uppers))
        along = F.when(high > low, F.floor((F.col("kid").cast("double") - low) / (high - low) * finer))
        bucket = bucket * finer + F.least(F.coalesce(along, F.lit(0)), F.lit(finer - 1))
    return bucket.cast("int")


def edited_fingerprints(docs: DataFrame, part: int = 3, most: int = 64) -> DataFrame:
    """Each document beside its edited text, whose last n_chars / part code points are the first of the next document:
    doc_id, n_chars, edited, bins, edited_bins, next_bins.

    The next document is that of the next smaller doc_id (ties: by hash; repeated rows follow each other; null is last), after the last the
    first. Documents travel once, to buckets of neighbouring doc_ids, in which the next one is the next row; the first document of each bucket
    (a bounded number of them, known by their keys) travels to the end of the bucket above as well."""
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("kid"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("th", F.xxhash64("text"))
    keyed = keyed.withColumn("bucket", _buckets(keyed.select("kid"), most))
    heads = keyed.groupBy("bucket").agg(F.max(F.struct("kid", "th")).alias("top")).select("bucket", "top.*").orderBy(F.desc("bucket")).collect()
    ends = [(h["kid"], h["th"], heads[k - 1]["bucket"]) for k, h in enumerate(heads)]  # the first one ends the last bucket
    ends = docs.sparkSession.createDataFrame(ends, "kid long, th long, bucket int")
    rows = with_bins(keyed, "text", "bins").withColumn("extra", F.lit(0))
    more = with_bins(keyed.drop("bucket").join(F.broadcast(ends), ["kid", "th"]).select(*keyed.columns), "text", "bins").withColumn("extra", F.lit(1))
    order = Window.partitionBy("bucket").orderBy("extra", F.desc("kid"), F.desc("th"))
    rows = rows.unionByName(more).withColumn("next", F.lead(F.struct("text", "bins")).over(order)).filter("extra = 0")
    n = F.char_length("text")
    rows = rows.select("doc_id", "text", "next", "bins", n.alias("n")).withColumn("m", F.expr(f"cast(n div {part} as int)"))
    out = rows.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.concat(F.expr("substring(text, 1, n - m)"), F.expr("substring(next.text, 1, m)")).alias("edited"), "bins", F.col("next.bins").alias("next_bins"))
    return with_bins(out, "edited", "edited_bins")
