"""SpotSigs fingerprints, from DataFrame functions alone.

A spot signature is a chain of ``CHAIN`` content words that follows an anchor, a common word (Theobald, Siddharth and Paepcke, 2008). With
the positions P of the anchors and the content words C of a text, the words that follow the j-th anchor begin at C[P[j] - j], since j anchors and so
P[j] - j content words stand before it; every signature is found by array access, in one pass. A fingerprint is the set of signature
hashes. Common words also follow anchors only as anchors, never in a chain.

A text without anchors takes every word as one, and a text without words has its own hash as only signature, so no fingerprint is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm.common import settle, texts

CHAIN = 2
THRESHOLD = 0.8
COARSE = 32
BUCKET_ROWS = 20_000

# Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his in is it its not of on or she that the their there they this to was were which will with you "
    "als am auch auf aus bei das dass dem den der des die ein eine einen einer es für ich im ist mit nach nicht noch sich sie sind um und uns von wie wir zu zum zur "
    "au aux avec ce cette dans de des du elle en est et il ils je la le les mais ne nous ou où par pas pour qu que qui sa se ses son sont sur un une vous "
    "al con como cuando del desde el ella entre era esa ese esta este fue hay las lo los más me mi muy no o para pero por porque si sin sobre su sus también te todo tu una uno y ya"
).split()


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sorted distinct signatures of column ``text``, longs.

    The steps are columns of their own: an array that a lambda looks into must not be built again for each element.
    """
    w, f, c, s = (f"__{out}_{x}" for x in ("words", "flags", "content", "spots"))
    df = df.withColumn(w, words(F.col(text)))
    df = df.withColumn(f, F.transform(w, lambda x: x.isin(ANCHORS)))
    df = df.withColumn(c, F.filter(w, lambda x, i: ~F.get(f, i)))
    at = F.filter(F.transform(f, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    chains = F.transform(at, lambda p, j: F.when(F.get(c, p - j).isNotNull(), F.xxhash64(F.get(w, p), *(F.get(c, p - j + k) for k in range(CHAIN)))))
    df = df.withColumn(s, F.filter(chains, lambda x: x.isNotNull()))
    shingles = F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, CHAIN + 1))))
    whole = F.when(F.size(w) > 0, shingles).otherwise(F.array(F.xxhash64(text)))
    return df.withColumn(out, F.sort_array(F.array_distinct(F.when(F.size(s) > 0, F.col(s)).otherwise(whole)))).drop(w, f, c, s)


def digest(signatures: str) -> Column:
    """A fingerprint as text: how many signatures, and the SHA-256 of their sorted hashes."""
    return F.concat_ws(":", F.size(signatures), F.sha2(F.array_join(F.transform(signatures, F.hex), ","), 256))


def jaccard(a: str, b: str) -> Column:
    """Shared signatures over all signatures of two fingerprints."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, signatures) of each row of ``docs``; null texts are empty."""
    return fingerprint(texts(docs), "text", "signatures").select("doc_id", "signatures")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Classes of equal fingerprints, (doc_id, class_id), and the pairs (left, right, likeness) of classes at ``threshold`` or above.

    A class id is the smallest doc_id of its class. Classes are partitioned by set length, in bounds whose ratio is the threshold, so that only
    equal or neighbouring partitions can hold likeness; within them classes meet on the signatures of their prefix, the size - ceil(threshold * size) + 1 rarest ones:
    likeness at the threshold needs one in common. Pairs whose lengths rule the threshold out go before their sets are compared.
    """
    marked = settle(fingerprints(docs), "spots")
    classed = marked.select("doc_id", "signatures", F.xxhash64("signatures").alias("h"))
    classes = settle(classed.groupBy("h").agg(F.min("doc_id").alias("class_id"), F.first("signatures").alias("signatures")), "spot-classes")
    members = classed.select("doc_id", "h").join(classes.select("h", "class_id"), "h").select("doc_id", "class_id")
    size = F.size("signatures")
    spread = classes.select("class_id", size.alias("size"), F.explode("signatures").alias("s"))
    rare = spread.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = spread.join(rare, "s", "left").withColumn("k", F.row_number().over(Window.partitionBy("class_id").orderBy(F.coalesce("df", F.lit(1)), "s")))
    prefix = ranked.filter((F.col("k") <= F.col("size") - F.ceil(F.col("size") * threshold) + 1) & (F.col("df") > 1)).select("class_id", "size", "s")
    part = F.floor(F.log("size") / F.lit(-1.0) / F.log(F.lit(threshold)))
    keyed = prefix.withColumn("part", part)
    left = keyed.select(F.col("class_id").alias("left"), F.col("size").alias("n"), "s", "part")
    right = keyed.select(F.col("class_id").alias("right"), F.col("size").alias("m"), "s", F.explode(F.array("part", F.col("part") - 1)).alias("part"))
    longer = (F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("right") > F.col("left")))
    found = left.join(right, ["s", "part"]).filter(longer & (F.col("n") >= F.col("m") * threshold)).select("left", "right").distinct()
    sets = classes.select("class_id", "signatures")
    whole = found.join(sets.withColumnsRenamed({"class_id": "left", "signatures": "a"}), "left").join(sets.withColumnsRenamed({"class_id": "right", "signatures": "b"}), "right")
    pairs = whole.select("left", "right", jaccard("a", "b").alias("likeness")).filter(F.col("likeness") >= threshold)
    return members, pairs.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "likeness")


def with_next(docs: DataFrame, prepare=lambda df: df, rows: int = BUCKET_ROWS) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, more by ``prepare``) with the columns of the next document, prefixed ``next_``.

    The next document is that of the next smaller doc_id; a null id is smaller than all others, equal ids go by falling text, and the first document
    follows the last. Documents are dealt to buckets of nearly equal counts, quantiles of the ids that are cut evenly further. The first document of
    each bucket also stands at the end of the bucket before, so neighbours meet after one shuffle and without a global order.
    """
    spark, key = docs.sparkSession, F.coalesce("doc_id", F.lit(-(1 << 63)))
    n, low, high = docs.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // rows))
    coarse, low, high = min(parts, COARSE), low or 0, high or 0
    cuts = docs.agg(F.percentile_approx("doc_id", [k / coarse for k in range(1, coarse)], 1000 * coarse)).first()[0] if coarse > 1 else None
    edges = sorted({low, *(cuts or [])})
    fine, spans = -(-parts // len(edges)), zip(edges, [*edges[1:], high + 1], strict=True)
    bucket = F.lit(0)
    for k, (a, b) in enumerate(spans):  # later edges are asked first
        inner = F.least(F.lit(fine - 1), F.floor((F.col("doc_id") - F.lit(a)).cast("double") / max(1, b - a) * fine).cast("int"))
        bucket = F.when(F.col("doc_id") >= a, k * fine + inner).otherwise(bucket)
    dealt = docs.withColumn("bucket", bucket.cast("int")).withColumn("key", key)
    by_bucket = Window.orderBy(F.desc("bucket"))  # over a row for each bucket
    heads = dealt.groupBy("bucket").agg(F.max("key").alias("head")).select("head", F.coalesce(F.lag("bucket").over(by_bucket), F.min("bucket").over(Window.partitionBy(F.lit(1)))).alias("before"))
    own = F.struct(F.col("bucket"), F.lit(False).alias("extra"))
    also = F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("extra")))
    placed = dealt.join(F.broadcast(heads), F.col("key") == F.col("head"), "left").withColumn("place", F.explode(F.array_compact(F.array(own, also))))
    placed = placed.drop("bucket", "head", "before").withColumns({"bucket": F.col("place.bucket"), "extra": F.col("place.extra")}).drop("place")
    ready = prepare(placed.repartitionById(len(edges) * fine, F.col("bucket")))
    order = Window.partitionBy("bucket").orderBy("extra", F.desc("key"), F.desc("text"))
    given = [c for c in ready.columns if c not in ("bucket", "extra", "key")]
    return ready.select(*given, "extra", *(F.lead(c).over(order).alias(f"next_{c}") for c in given)).filter(~F.col("extra")).drop("extra")


def edits(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint beside that of its edited text and of the next document.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures. A row alone is its own next document.
    """
    pairs = with_next(texts(docs), lambda df: fingerprint(df, "text", "signatures"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    both = fingerprint(pairs.withColumn("edited", edited), "edited", "edited_signatures")
    return both.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), digest("signatures").alias("fingerprint"), digest("edited_signatures").alias("edited_fingerprint"),
        jaccard("signatures", "edited_signatures").alias("near_edited"), jaccard("signatures", "next_signatures").alias("near_next"), F.size("signatures").cast("long").alias("n_signatures"),
    )
