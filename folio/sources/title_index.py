"""A search index of titles: posting lists of their n-grams, in buckets, with positions.

A search reads only the buckets of its own n-grams, and of these, sorted by n-gram, the row groups
that hold them.  Positions make it exact: a title contains the query where all of the query's
n-grams follow one another, so no title is read to verify.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import search_text, with_search_text

#: Characters of the longest n-gram; shorter queries are n-grams themselves.
WIDTH = 3
#: Folders of an index, and tasks at least that write one, so that a common n-gram does not fall to one task.
BUCKETS, WRITERS = 32, 2
#: Characters of titles for each further writer of a folder, so that a task sorts as much however many titles there are.
WRITER_CHARS = 4_000_000
POSTING = "bucket int, gram string, kind string, id long, pos int"


def _bucket(gram: str) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def postings(titles: DataFrame) -> DataFrame:
    """(kind, id, title) -> (bucket, gram, kind, id, pos): the n-grams of up to WIDTH characters at every place of the title's search form."""
    rows = with_search_text(titles.select("kind", F.col("id").cast("long").alias("id"), "title"), "title", "form").where("form <> ''")
    at = F.sequence(F.lit(1), F.length("form"))
    rows = rows.select("kind", "id", "form", F.explode(at).alias("pos"))
    cut = F.array(*[F.when(F.col("pos") + n - 1 <= F.length("form"), F.substring(F.col("form"), F.col("pos"), F.lit(n))) for n in range(1, WIDTH + 1)])
    rows = rows.select("kind", "id", "pos", F.explode(F.array_compact(cut)).alias("gram"))
    return rows.select(_bucket("gram").alias("bucket"), "gram", "kind", "id", "pos")


def write_title_index(titles: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Index of titles (kind, id, title); ids are unique within a kind.  Further titles are added with mode append."""
    chars = titles.agg(F.sum(F.length("title"))).first()[0] or 0
    writers = max(WRITERS, -(-chars // WRITER_CHARS))
    dealt = postings(titles).repartition(BUCKETS * writers, "bucket", F.pmod(F.xxhash64("id"), F.lit(writers)))
    dealt.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").mode(mode).parquet(path)


def search_titles(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(kind, id) of the titles that contain the query, which must not be blank."""
    q = search_text(query)
    if not q:
        raise ValueError("a blank query has no n-grams")
    n = min(WIDTH, len(q))
    grams = [q[k : k + n] for k in range(len(q) - n + 1)]
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in set(grams)], "gram string").select(_bucket("gram")).distinct().collect()]
    places = F.create_map(*[x for g in dict.fromkeys(grams) for x in (F.lit(g), F.array(*[F.lit(k) for k, y in enumerate(grams) if y == g]))])
    found = spark.read.schema(POSTING).parquet(path).where(F.col("bucket").isin(buckets) & F.col("gram").isin(list(dict.fromkeys(grams))))
    begun = found.select("kind", "id", "pos", F.explode(places[F.col("gram")]).alias("k")).select("kind", "id", (F.col("pos") - F.col("k")).alias("begin"), "k").distinct()
    return begun.groupBy("kind", "id", "begin").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("kind", "id").distinct()


def catalogue_titles(works: DataFrame, chapters: DataFrame) -> DataFrame:
    """What an index of a catalogue holds: kind `work` or `chapter`, id, title."""
    return works.select(F.lit("work").alias("kind"), F.col("work_id").alias("id"), "title").unionByName(chapters.select(F.lit("chapter").alias("kind"), F.col("chapter_id").alias("id"), "title"))


def search_indexed(works: DataFrame, chapters: DataFrame, path: str, query: str) -> DataFrame:
    """search_catalogue by an index of catalogue_titles: the same rows, without a look at the titles."""
    w, c = works.select("work_id", "work_ord"), chapters.select("work_id", "chapter_id", "chapter_ord")
    names = ["work_id", "chapter_id", "work_ord", "chapter_ord"]
    if not search_text(query):
        return w.join(c, "work_id", "left").select(*names)
    hits = search_titles(works.sparkSession, path, query)
    of = lambda kind, key: hits.where(F.col("kind") == kind).select(F.col("id").alias(key))
    whole = w.join(of("work", "work_id"), "work_id", "left_semi").join(c, "work_id", "left").select(*names)
    single = c.join(of("chapter", "chapter_id"), "chapter_id", "left_semi").join(w, "work_id").select(*names)
    return whole.unionByName(single).distinct()
