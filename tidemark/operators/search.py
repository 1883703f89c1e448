"""T family: postings, phrase and prefix matching, tiered BM25 ranking, snippets, HTML to text.

Postings are (term, doc, col, offset). A query over plain texts picks its own terms inside each text's array of words, so
that no other word becomes a row; an Index has all postings as files, of which a query reads its terms' buckets only. Scores follow the published BM25 formula (k1 = 1.2, b = 0.75) over weighted term frequencies,
negated so that better hits sort first.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import blocks, textual
from tidemark.functions.stemming import stem
from tidemark.plans.dialect import Registry
from tidemark.sources.scratch import scratch, written
from tidemark.sources.tables import table

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

K1, B, TITLE_WEIGHT = 1.2, 0.75, 10.0
_NOT_WORD = r"[^\p{L}\p{N}]+"


def terms_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _NOT_WORD), lambda t: t != "")


def asked(parsed: textual.Parsed) -> tuple[list[str], list[str]]:
    """Words and prefixes that any mode of a search may look up: the last word also stands for a prefix."""
    prefixes = {u.words[-1] for u in parsed.units if u.prefix} | {parsed.units[-1].words[-1]}
    return sorted({w for u in parsed.units for w in u.words}), sorted(prefixes)


def _is_asked(term: Column, words: list[str], prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [term.startswith(x) for x in prefixes], term.isin(words))


def postings(docs: DataFrame, key: str, columns: list[str], parsed: textual.Parsed | None = None) -> DataFrame:
    """term, doc, col, offset (from 0); with parsed only the terms that it asks for, which become rows of their own."""
    parts = F.array(*[F.struct(F.lit(c).alias("col"), terms_of(F.col(c)).alias("terms")) for c in columns])
    each = docs.select(F.col(key).alias("doc"), F.explode(parts).alias("p"))
    if parsed is None:
        return each.select("doc", F.col("p.col").alias("col"), F.posexplode("p.terms").alias("offset", "term")).select("term", "doc", "col", "offset")
    placed = F.transform("p.terms", lambda t, i: F.struct(t.alias("term"), i.alias("offset")))
    mine = F.filter(placed, lambda x: _is_asked(x.term, *asked(parsed)))
    return each.select("doc", F.col("p.col").alias("col"), F.explode(mine).alias("x")).select("x.term", "doc", "col", "x.offset")


class Index:
    """Stored postings (bucket, term, doc, col, offset) and document lengths.

    A bucket holds the terms whose first two characters hash alike, so that a word or a prefix of two letters is looked
    up in one bucket; in it files are ranges of (term, doc), so that statistics skip what lies beside the term.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.lengths = spark.read.parquet(f"{self.path}/lengths")

    @classmethod
    def build(cls, docs: DataFrame, key: str, columns: list[str], path: str, buckets: int = BUCKETS) -> "Index":
        """columns: title and body, or body alone."""
        path, sizes = path.rstrip("/"), [F.size(terms_of(F.col(c))).alias(f"{n}_len") for c, n in zip(columns, ("title", "body")[-len(columns) :])]
        if len(columns) == 1:
            sizes = [F.lit(0).alias("title_len"), *sizes]
        docs.select(F.col(key).alias("doc"), *sizes).write.parquet(f"{path}/lengths")
        placed = postings(docs, key, columns).withColumn("bucket", cls._bucket(F.col("term"), buckets))
        rows = placed.repartitionByRange("bucket", "term", "doc").sortWithinPartitions("bucket", "term", "doc", "col", "offset")
        rows.write.partitionBy("bucket").parquet(f"{path}/postings-{buckets}")
        return cls(docs.sparkSession, path)

    @staticmethod
    def _bucket(term: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.substring(term, 1, 2)), F.lit(buckets)).cast("int")

    def postings(self, parsed: textual.Parsed | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/postings-{self.BUCKETS}")
        if parsed is not None:
            words, prefixes = asked(parsed)
            wanted = [*words, *prefixes]
            if all(len(w) >= 2 for w in prefixes):
                here = self.spark.createDataFrame([(w,) for w in wanted], "term string").select(self._bucket(F.col("term"), self.BUCKETS).alias("b")).distinct().collect()
                rows = rows.where(F.col("bucket").isin([r.b for r in here]))
            rows = rows.where(_is_asked(F.col("term"), words, prefixes))
        return rows.select("term", "doc", "col", "offset")


def _alike(unit: textual.Unit, last: bool) -> Column:
    word = unit.words[-1] if last else unit.words[0]
    return F.col("term").startswith(word) if unit.prefix and last else F.col("term") == word


def unit_matches(post: DataFrame, unit: textual.Unit) -> DataFrame:
    """doc of every document that has the unit: a term, a prefix, or words at consecutive offsets of one column."""
    words = unit.words
    if len(words) == 1:
        return post.where(_alike(unit, True)).select("doc").distinct()
    out = None
    for i, w in enumerate(words):
        cond = F.col("term").startswith(w) if unit.prefix and i == len(words) - 1 else F.col("term") == w
        one = post.where(cond).select("doc", "col", (F.col("offset") - i).alias("at")).distinct()
        out = one if out is None else out.join(one, ["doc", "col", "at"])
    return out.select("doc").distinct()


def match(post: DataFrame, parsed: textual.Parsed, mode: str = "all") -> DataFrame:
    """Documents that have all units, all with the last one as a prefix, or any."""
    units = list(parsed.units)
    if mode == "prefix":
        units[-1] = textual.Unit(units[-1].text, True)
    found = [unit_matches(post, u) for u in units]
    if mode == "any":
        return reduce(lambda a, b: a.unionByName(b), found).distinct()
    return reduce(lambda a, b: a.join(b, "doc"), found)


def ladder(post: DataFrame, parsed: textual.Parsed) -> tuple[str, DataFrame]:
    """The mode that finds something: all, then prefix, then any."""
    hits = match(post, parsed)
    last = parsed.units[-1]
    if not hits.isEmpty():
        return "all", hits
    if not last.prefix and len(last.text) >= 3:
        hits = match(post, parsed, "prefix")
        if not hits.isEmpty():
            return "prefix", hits
    if len(parsed.units) > 1:
        return "any", match(post, parsed, "any")
    return "all", hits


def bm25(post: DataFrame, lengths: DataFrame, parsed: textual.Parsed) -> DataFrame:
    """doc, score: lower is better. lengths: doc, title_len, body_len of all documents."""
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("title_len") + F.col("body_len")).alias("avgdl"))
    wanted = sorted({w for u in parsed.units for w in u.words})
    tf = post.where(F.col("term").isin(wanted)).groupBy("term", "doc").agg(F.sum(F.when(F.col("col") == "title", TITLE_WEIGHT).otherwise(1.0)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    j = tf.join(F.broadcast(df), "term").join(lengths, "doc").join(F.broadcast(stats))  # one row of statistics
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.col("tf") + K1 * (1 - B + B * (F.col("title_len") + F.col("body_len")) / F.col("avgdl"))
    return j.groupBy("doc").agg(F.round(-F.sum(idf * F.col("tf") * (K1 + 1) / norm), 6).alias("score"))


def tier(title: Column, wanted: str) -> Column:
    """0 the title itself, 1 it starts so, 2 it holds it, 3 otherwise; ASCII case doesn't count."""
    t, w = F.lower(title), wanted.lower()
    return F.when(t == w, 0).when(t.startswith(w), 1).when(F.instr(t, w) > 0, 2).otherwise(3)


def lengths(docs: DataFrame, key: str, title: str, body: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc"), F.size(terms_of(F.col(title))).alias("title_len"), F.size(terms_of(F.col(body))).alias("body_len"))


def digest(docs: DataFrame, key: str, title: str, body: str, parsed: textual.Parsed) -> tuple[DataFrame, DataFrame]:
    """Postings that parsed asks for, and all lengths, from one pass over the texts: both are read again from what it wrote."""
    words = docs.select(F.col(key).alias("doc"), terms_of(F.col(title)).alias("title"), terms_of(F.col(body)).alias("body"))

    def placed(c: str) -> Column:
        return F.transform(c, lambda t, i: F.struct(t.alias("term"), F.lit(c).alias("col"), i.alias("offset")))

    mine = F.filter(F.concat(placed("title"), placed("body")), lambda x: _is_asked(x.term, *asked(parsed)))
    facts = written(words.select("doc", F.size("title").alias("title_len"), F.size("body").alias("body_len"), mine.alias("hits")))
    return facts.select("doc", F.explode("hits").alias("x")).select("x.term", "doc", "x.col", "x.offset"), facts.select("doc", "title_len", "body_len")


def search(docs: DataFrame, key: str, title: str, body: str, text: str, page: int = 0, size: int = 20, index: Index | None = None) -> DataFrame:
    """One page of ranked hits: doc, title, tier, score, mode, and the body of this page's hits only. With an index of
    docs no text is read but theirs."""
    parsed = textual.parse_query(text)
    named = docs.select(F.col(key).alias("doc"), F.col(title).alias("title"), F.col(body).alias("body"))
    post, sizes = (index.postings(parsed), index.lengths) if index else digest(docs, key, title, body, parsed)
    mode, hits = ladder(post, parsed)
    ranked = hits.join(bm25(post, sizes, parsed), "doc", "left").join(named.select("doc", "title"), "doc")
    ranked = ranked.select("doc", "title", tier(F.col("title"), parsed.title).alias("tier"), F.coalesce("score", F.lit(0.0)).alias("score"))
    last = max(0, -(-ranked.count() // size) - 1)
    top = ranked.orderBy("tier", "score", F.lower("title"), "doc").offset(max(0, min(page, last)) * size).limit(size)
    return top.join(named.select("doc", "body"), "doc").select("doc", "title", "tier", "score", F.lit(mode).alias("mode"), "body")


# ---- queries over documents (title = source, body = text) and pages ----

_P = r"""WITH w AS (SELECT doc_id AS doc, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS ts FROM documents),
p AS (SELECT doc, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM w)
"""


def _post(spark, sf_dir, parsed: textual.Parsed | None = None) -> DataFrame:
    return postings(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body")), "doc_id", ["body"], parsed)


def _matching(spark, sf_dir, text: str, mode: str = "all") -> DataFrame:
    parsed = textual.parse_query(text)
    return match(written(_post(spark, sf_dir, parsed)), parsed, mode)


@_r.query("t01_query_parser", "SELECT * FROM (VALUES (0, 'of the', false), (1, 'tion', true), (2, 'plain', false)) AS t(place, unit, prefix)")
def _parser(spark, sf_dir):
    parsed = textual.parse_query('"of the" tion* -- plain')
    return spark.createDataFrame([(i, u.text, u.prefix) for i, u in enumerate(parsed.units)], "place int, unit string, prefix boolean")


@_r.query("t02_match_all", _P + "SELECT DISTINCT a.doc FROM p a JOIN p b ON a.doc = b.doc WHERE a.term = 'license' AND b.term = 'under'")
def _all(spark, sf_dir):
    return _matching(spark, sf_dir, "license under")


@_r.query("t02_match_prefix", _P + "SELECT DISTINCT a.doc FROM p a JOIN p b ON a.doc = b.doc WHERE a.term = 'under' AND b.term LIKE 'licen%'")
def _prefix(spark, sf_dir):
    return _matching(spark, sf_dir, "under licen", "prefix")


@_r.query("t02_match_any", _P + "SELECT DISTINCT doc FROM p WHERE term IN ('apache', 'reserved')")
def _any(spark, sf_dir):
    return _matching(spark, sf_dir, "apache reserved", "any")


@_r.query("t03_fallback_ladder", _P + "SELECT 'prefix' AS mode, count(DISTINCT a.doc) AS hits FROM p a JOIN p b ON a.doc = b.doc WHERE a.term = 'under' AND b.term LIKE 'licens%'")
def _ladder(spark, sf_dir):
    parsed = textual.parse_query("under licens")
    mode, hits = ladder(written(_post(spark, sf_dir, parsed)), parsed)
    return hits.agg(F.count(F.lit(1)).alias("hits")).select(F.lit(mode).alias("mode"), "hits")


@_r.query("t04_phrase_match", _P + "SELECT DISTINCT a.doc FROM p a JOIN p b ON a.doc = b.doc AND b.pos = a.pos + 1 JOIN p c ON a.doc = c.doc AND c.pos = a.pos + 2 WHERE a.term = 'all' AND b.term = 'rights' AND c.term = 'reserved'")
def _phrase(spark, sf_dir):
    return _matching(spark, sf_dir, '"all rights reserved"')


@_r.query("t04_term_first_rows", _P + "SELECT DISTINCT doc FROM p WHERE term = 'the' ORDER BY doc LIMIT 32")
def _first(spark, sf_dir):
    """Term rows in document order: which texts have the word is decided inside each, and no postings are made."""
    d = table(spark, sf_dir, "documents").where(F.array_contains(terms_of(F.col("text")), "the"))
    return d.select(F.col("doc_id").alias("doc")).distinct().orderBy("doc").limit(32)


@_r.query("t05_vocabulary", _P + "SELECT term, count(DISTINCT doc) AS docs, count(*) AS instances FROM p GROUP BY term")
def _vocabulary(spark, sf_dir):
    return vocabulary(table(spark, sf_dir, "documents"), "doc_id", "text")


@_r.query("t05_instances", _P + "SELECT term, doc, pos AS \"offset\" FROM p WHERE term LIKE 'lic%'")
def _instances(spark, sf_dir):
    return _post(spark, sf_dir, textual.parse_query("lic*")).select("term", "doc", "offset")


_BM = (
    _P
    + """, l AS (SELECT doc, len(ts) AS dl FROM w), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l), tf AS (SELECT term, doc, count(*)::DOUBLE AS tf FROM p WHERE term IN ('license', 'under') GROUP BY term, doc),
      df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
      SELECT tf.doc, round(-sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term) JOIN l USING (doc), s GROUP BY tf.doc"""
)


@_r.query("t06_bm25", _BM)
def _bm25(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("title"), F.col("text").alias("body"))
    parsed = textual.parse_query("license under")
    return bm25(*digest(d, "doc_id", "title", "body", parsed), parsed)


@_r.query("t07_tiered_ranking", "SELECT doc_id AS doc, CASE WHEN source = 'src1' THEN 0 WHEN starts_with(source, 'src1') THEN 1 WHEN contains(source, 'src1') THEN 2 ELSE 3 END AS tier FROM documents")
def _tiers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), tier(F.col("source"), "SRC1").alias("tier"))


_PAGE = r"""WITH w AS (SELECT doc_id AS doc, source AS title, list_filter(regexp_split_to_array(lower(coalesce(source, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS tt,
                  list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS bt FROM documents),
  p AS (SELECT doc, unnest(tt) AS term, 10.0 AS weight FROM w UNION ALL SELECT doc, unnest(bt), 1.0 FROM w),
  tf AS (SELECT term, doc, sum(weight)::DOUBLE AS tf FROM p WHERE term IN ('license', 'under') GROUP BY term, doc), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  l AS (SELECT doc, title, len(tt) + len(bt) AS dl FROM w), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
  m AS (SELECT doc FROM tf GROUP BY doc HAVING count(*) = 2)
  SELECT doc, title, 3 AS tier, score, 'all' AS mode FROM (SELECT tf.doc, title, round(-sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM tf JOIN df USING (term) JOIN l USING (doc) JOIN m USING (doc), s GROUP BY tf.doc, title) x ORDER BY score, lower(title), doc LIMIT 20"""


@_r.query("s23_search_page", _PAGE)
def _page(spark, sf_dir):
    """Matches joined to their rows by key in order of rank; bodies are read for one page of hits."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("body"))
    return search(d, "doc_id", "title", "body", "license under").drop("body")


@_r.query("s23_indexed_page", _PAGE)
def _indexed(spark, sf_dir):
    """The same page from stored postings: of the texts only this page's are read."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("body"))
    index = Index.build(d, "doc_id", ["title", "body"], scratch(spark))
    return search(d, "doc_id", "title", "body", "license under", index=index).drop("body")


@_r.query("t08_like_fallback", "SELECT page_id, url, 0 AS score FROM pages WHERE lower(url) LIKE '%a!_%' ESCAPE '!' OR lower(url) LIKE '%example%'")
def _like(spark, sf_dir):
    u = F.lower("url")
    return table(spark, sf_dir, "pages").where(F.contains(u, F.lit("a_")) | F.contains(u, F.lit("example"))).select("page_id", "url", F.lit(0).alias("score"))


@_r.query("t09_late_payload", "SELECT page_id, length(html)::BIGINT AS n_html FROM pages ORDER BY url, page_id LIMIT 20")
def _payload(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    top = p.select("page_id", "url").orderBy("url", "page_id").limit(20).select("page_id")
    return p.join(F.broadcast(top), "page_id").select("page_id", F.length("html").cast("long").alias("n_html"))


def snippets(docs: DataFrame, key: str, body: str, terms: tuple[str, ...]) -> DataFrame:
    @F.pandas_udf("struct<text: string, before: boolean, after: boolean, hits: array<struct<start: int, end: int>>>")
    def cut(s: pd.Series) -> pd.DataFrame:
        rows = [textual.snippet(x, terms) for x in s]
        return pd.DataFrame({"text": [r["text"] for r in rows], "before": [r["before"] for r in rows], "after": [r["after"] for r in rows], "hits": [[{"start": a, "end": b} for a, b in r["hits"]] for r in rows]})

    return docs.select(F.col(key).alias("doc"), cut(F.col(body)).alias("s")).select("doc", "s.*")


@_r.query("t10_snippets")
def _snippets(spark, sf_dir):
    return snippets(table(spark, sf_dir, "documents").where(F.lower("text").contains("licen")), "doc_id", "text", ("license", "under"))


@_r.query("t11_html_to_text")
def _html(spark, sf_dir):
    plain = F.pandas_udf(lambda s: s.map(textual.html_text), "string")
    return table(spark, sf_dir, "pages").select("page_id", plain("html").alias("text"))


#: Bytes of text, and words, that are counted at once.
_TEXT_BLOCK, _WORD_BLOCK = 4 << 20, 1 << 20


def _single(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key no other row has, and the rest (a key more than once, or none), None where there is no such row.
    Of the first, a count of rows is a count of keys, and no key has to be shuffled with what it holds."""
    again = written(docs.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 OR _k IS NULL").select("_k"))
    if again.isEmpty():
        return docs, None
    same = F.col(key).eqNullSafe(F.col("_k"))
    return docs.join(again, same, "left_anti"), docs.join(again, same, "left_semi")


def _lowered(docs: DataFrame, column: str) -> Column:
    blocks.bounded(docs.sparkSession)
    return F.lower(F.coalesce(F.col(column), F.lit(""))).alias("text")


def trigrams(docs: DataFrame, key: str, column: str) -> DataFrame:
    """gram, docs: different runs of three lower-cased characters, with the keys of a block's texts that have each, once a
    row of docs. A gram has a row in every block that knows it."""

    def run(batches):
        for b in blocks.gathered(batches, blocks.text_sizes(1), _TEXT_BLOCK):
            for runs, offsets, texts in blocks.grams(b.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), b.column(0).take(pa.array(texts)))
                yield pa.RecordBatch.from_arrays([pa.array(runs), lists], ["gram", "docs"])

    rows = docs.select(F.col(key).alias("doc"), _lowered(docs, column))
    return rows.mapInArrow(run, f"gram string, docs array<{dict(rows.dtypes)['doc']}>")


def gram_counts(docs: DataFrame, key: str, column: str) -> DataFrame:
    """gram, docs: how many different keys have each run of three lower-cased characters."""

    def run(batches):
        for b in blocks.gathered(batches, blocks.text_sizes(0), _TEXT_BLOCK):
            for runs, offsets, _ in blocks.grams(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(runs), pa.array(np.diff(offsets), pa.int64())], ["gram", "docs"])

    single, again = _single(docs, key)
    n = single.select(_lowered(single, column)).mapInArrow(run, "gram string, docs long")
    if again is not None:
        n = n.unionByName(trigrams(again, key, column).select("gram", F.explode("docs").alias("doc")).groupBy("gram").agg(F.count_distinct("doc").alias("docs")))
    return n.groupBy("gram").agg(F.sum("docs").alias("docs"))


def substring_search(docs: DataFrame, key: str, column: str, needle: str, grams: DataFrame | None = None) -> DataFrame:
    """doc of every row whose column holds needle, whatever its case. grams (gram, docs) are stored trigrams: rows that
    have all of needle's are candidates, and only they are read; without it, and for shorter needles, texts are scanned."""
    needle = needle.lower()
    wanted = sorted({needle[i : i + 3] for i in range(len(needle) - 2)})
    rows = docs.select(F.col(key).alias("doc"), F.col(column).alias("text"))
    if grams is not None and wanted:
        held = grams.where(F.col("gram").isin(wanted)).select("gram", F.explode("docs").alias("doc"))
        near = held.groupBy("doc").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted))
        rows = rows.join(near.select(F.col("doc").alias("_d")), F.col("doc").eqNullSafe(F.col("_d")), "left_semi")
    return rows.where(F.contains(F.lower("text"), F.lit(needle))).select("doc").distinct()


@_r.query(
    "t12_trigrams",
    "WITH s AS (SELECT doc_id, lower(coalesce(text, '')) AS s FROM documents), g AS (SELECT doc_id, s, unnest(range(1, length(s) - 1)) AS i FROM s) SELECT substr(s, i, 3) AS gram, count(DISTINCT doc_id) AS docs FROM g GROUP BY substr(s, i, 3)",
)
def _trigrams(spark, sf_dir):
    return gram_counts(table(spark, sf_dir, "documents"), "doc_id", "text")


@_r.query("t12_substring_search", "SELECT DISTINCT doc_id AS doc FROM documents WHERE contains(lower(text), 'nsed under th')")
def _substring(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return substring_search(d, "doc_id", "text", "nsed UNDER th", written(trigrams(d, "doc_id", "text")))


def normalised(post: DataFrame, how) -> DataFrame:
    """Postings under another form of their terms: the form is made once for each different term, not for each place."""
    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(how)

    forms = post.select("term").distinct().select(F.col("term").alias("_t"), form("term").alias("_f"))
    return post.join(forms, F.col("term") == F.col("_t")).select(F.col("_f").alias("term"), "doc", "col", "offset")


def vocabulary(docs: DataFrame, key: str, column: str, how=None) -> DataFrame:
    """term, docs, instances: each different term (in the form that how gives it), how many different keys have it, and how
    often it stands. Words are counted in blocks of texts, so that only a block's different terms become rows."""

    def run(batches):
        known: dict[str, str] = {}
        for b in blocks.gathered(batches, blocks.list_sizes(0), _WORD_BLOCK):
            terms, n, instances = blocks.counts(b.column(0), how, known)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(n, pa.int64()), pa.array(instances, pa.int64())], ["term", "docs", "instances"])

    blocks.bounded(docs.sparkSession)
    single, again = _single(docs, key)
    n = single.select(terms_of(F.col(column)).alias("terms")).mapInArrow(run, "term string, docs long, instances long")
    if again is not None:
        post = postings(again, key, [column])
        post = normalised(post, how) if how is not None else post
        n = n.unionByName(post.groupBy("term").agg(F.count_distinct("doc").alias("docs"), F.count(F.lit(1)).alias("instances")))
    return n.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("instances").alias("instances"))


@_r.query("t13_folded_vocabulary", _P + "SELECT strip_accents(term) AS term, count(DISTINCT doc) AS docs, count(*) AS instances FROM p GROUP BY strip_accents(term)")
def _folded(spark, sf_dir):
    """Terms without their accents."""
    return vocabulary(table(spark, sf_dir, "documents"), "doc_id", "text", textual.fold)


@_r.query("t13_stemmed_match", _P + "SELECT DISTINCT doc FROM p WHERE term IN ('license', 'licensed', 'licenses', 'licensing', 'licens')")
def _stemmed(spark, sf_dir):
    """Any form of a word finds every other one."""
    post = _post(spark, sf_dir, textual.parse_query("licens*"))
    return normalised(post, stem).where(F.col("term") == stem("licensing")).select("doc").distinct()


@_r.query("s56_derived_index", _P.replace("lower(coalesce(text, ''))", "lower(CASE WHEN doc_id % 50 = 0 THEN 'fresh words here' ELSE coalesce(text, '') END)") + "SELECT term, count(*) AS n FROM p GROUP BY term")
def _derived(spark, sf_dir):
    """After an update only changed documents' postings are computed anew and replace the old ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    changed = d.where("doc_id % 50 = 0").withColumn("body", F.lit("fresh words here"))
    kept = postings(d, "doc_id", ["body"]).join(changed.select(F.col("doc_id").alias("doc")), "doc", "left_anti")
    return kept.unionByName(postings(changed, "doc_id", ["body"])).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@_r.query("t14_session_api", "SELECT 'get' AS call, 1::BIGINT AS n UNION ALL SELECT 'all', (SELECT count(*) FROM nation WHERE n_regionkey = 2) UNION ALL SELECT 'queries', 2 UNION ALL SELECT 'errors', 1")
def _session(spark, sf_dir):
    """prepare, get, all; an error leaves the session usable and is counted."""
    from tidemark.plans.session import QueryError, Session

    with Session(spark, sf_dir) as db:
        st = db.prepare("SELECT n_name FROM nation WHERE n_regionkey = :r")
        one = db.get("SELECT count(*) AS n FROM region WHERE r_regionkey = ?", [1])
        try:
            db.all("SELECT n_name FROM nation", max_rows=3)
        except QueryError:
            pass
        rows = st.all({"r": 2})
        m = db.stats()
    return spark.createDataFrame([("get", one.n), ("all", len(rows)), ("queries", m.queries - 1), ("errors", m.errors)], "call string, n long")


@_r.query(
    "t15_query_metrics",
    "SELECT 'all' AS call, (SELECT count(*) FROM nation WHERE n_regionkey = 2) AS n, 1::BIGINT AS files, 0::BIGINT AS errors UNION ALL SELECT 'one', 1, 1, 0 UNION ALL SELECT 'none', 1, 0, 0 UNION ALL SELECT 'error', 0, 0, 1 UNION ALL SELECT 'total', (SELECT count(*) + 2 FROM nation WHERE n_regionkey = 2), 2, 1",
)
def _query_metrics(spark, sf_dir):
    """What each query of a session adds: rows, files that its scans read, errors; and their totals."""
    from tidemark.plans.session import QueryError, Session

    with Session(spark, sf_dir) as db:
        out = {}
        calls = {"all": lambda: db.all("SELECT n_name FROM nation WHERE n_regionkey = 2"), "one": lambda: db.get("SELECT count(*) AS n FROM region"), "none": lambda: db.get("SELECT 1 AS x"), "error": lambda: db.all("SELECT * FROM nation", max_rows=3)}
        for name, call in calls.items():
            try:
                call()
            except QueryError:
                pass
            out[name] = db.last
        out["total"] = db.stats()
    return spark.createDataFrame([(k, m.rows, m.files, m.errors) for k, m in out.items()], "call string, n long, files long, errors long")
