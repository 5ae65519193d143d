"""Registered queries of the search engine, each over whole tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

import copy
import pickle
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import register
from .operators import search, sequences, suffixes
from .operators.grams import GramIndex
from .plans import CollectionSearch, TextSearch
from .sources.corpus import Corpus
from .sources.store import fresh_path, saved

WORD, OVERLAPPING, LONG, PREFIX, SUFFIX, DOC = "the", "enen", "ment en ", "The ", ".", 7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def count_per_doc(spark, sf_dir):
    return search.counts(_docs(spark, sf_dir), WORD)


def count_overlap(spark, sf_dir):
    return search.counts(_docs(spark, sf_dir), OVERLAPPING)


def count_empty(spark, sf_dir):
    return search.counts(_docs(spark, sf_dir), "")


def count_all(spark, sf_dir):
    return search.count_all(_docs(spark, sf_dir), WORD)


def count_in_doc(spark, sf_dir):
    return search.counts(_docs(spark, sf_dir), "e", doc_id=DOC)


def top_documents(spark, sf_dir):
    return search.top_k(_docs(spark, sf_dir), WORD, 10)


def locate(spark, sf_dir):
    return search.locate(_docs(spark, sf_dir), WORD)


def locate_overlap(spark, sf_dir):
    return search.locate(_docs(spark, sf_dir), OVERLAPPING)


def locate_by_windows(spark, sf_dir):
    return search.locate_by_windows(_docs(spark, sf_dir), WORD)


def locate_in_chunks(spark, sf_dir):
    return search.locate_in_chunks(_docs(spark, sf_dir), WORD, 1000)


def locate_in_doc(spark, sf_dir):
    return search.locate(_docs(spark, sf_dir), "e", doc_id=DOC).select("pos")


def locate_empty(spark, sf_dir):
    return search.locate(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text")), "")


def locate_grouped(spark, sf_dir):
    found = search.grouped(search.locate(_docs(spark, sf_dir), WORD))
    return found.select("doc_id", F.array_join("positions", ",").alias("positions"))


def _facade(spark, sf_dir) -> CollectionSearch:
    return CollectionSearch.of(Corpus.from_table(_docs(spark, sf_dir), check=False))


def iterated(spark, sf_dir):
    """Occurrences in all documents, as the iterator gives them."""
    return spark.createDataFrame(list(_facade(spark, sf_dir).iter_locate(LONG)), "doc_id bigint, pos bigint")


def iterated_in_doc(spark, sf_dir):
    return spark.createDataFrame([(pos,) for pos in _facade(spark, sf_dir).iter_locate("e", doc_id=DOC)], "pos bigint")


def iterated_text(spark, sf_dir):
    """Occurrences in the text of one document, by the iterator of a search made from a string."""
    text = _docs(spark, sf_dir).where(F.col("doc_id") == DOC).select("text").first()[0]
    return spark.createDataFrame([(pos,) for pos in TextSearch(text).iter_locate("e")], "pos bigint")


def copied_names(spark, sf_dir):
    """Counts in a search made from a list of strings, in its copies, and in what is pickled and read back."""
    names = [r.r_name for r in _table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    x = CollectionSearch(names)
    made = {"made": x, "copy": copy.copy(x), "deepcopy": copy.deepcopy(x), "pickle": pickle.loads(pickle.dumps(x))}
    rows = [(source, doc, n) for source, y in made.items() for doc, n in y.count("A").items()]
    return spark.createDataFrame(rows, "source string, doc_id bigint, n bigint")


def document_starts(spark, sf_dir):
    return suffixes.document_starts(_docs(spark, sf_dir))


def contains_substring(spark, sf_dir):
    return search.containing(_docs(spark, sf_dir), WORD)


def contains_document(spark, sf_dir):
    """Documents equal to the text of one of them."""
    docs = _docs(spark, sf_dir)
    return search.equal_to(docs, docs.where(F.col("doc_id") == DOC).select("text").first()[0])


def starts_with(spark, sf_dir):
    return search.starting_with(_docs(spark, sf_dir), PREFIX)


def ends_with(spark, sf_dir):
    return search.ending_with(_docs(spark, sf_dir), SUFFIX)


def corpus_stats(spark, sf_dir):
    s = Corpus.from_table(_docs(spark, sf_dir)).stats
    return spark.createDataFrame([(s.num_docs, s.total_num_chars, s.max_bit)], "num_docs bigint, total_num_chars bigint, max_bit int")


def items(spark, sf_dir):
    return Corpus.from_table(_docs(spark, sf_dir), check=False).items()


def saved_corpus(spark, sf_dir):
    """Items of a corpus that was written and loaded again."""
    path = fresh_path(spark, "corpus")
    Corpus.from_table(_docs(spark, sf_dir)).save(path)
    return Corpus.load(spark, path).items()


def sql_function(spark, sf_dir):
    register(spark)
    _docs(spark, sf_dir).createOrReplaceTempView("textloom_documents")
    return spark.sql(f"SELECT doc_id, overlap_count(text, '{OVERLAPPING}') AS n FROM textloom_documents")


def sql_table_function(spark, sf_dir):
    register(spark)
    _docs(spark, sf_dir).createOrReplaceTempView("textloom_documents")
    return spark.sql(f"SELECT doc_id, pos FROM textloom_documents, LATERAL occurrences(text, '{OVERLAPPING}')")


def _index(spark, sf_dir) -> GramIndex:
    return GramIndex.build(Corpus.from_table(_docs(spark, sf_dir), check=False), fresh_path(spark, "grams"))


def gram_locate(spark, sf_dir):
    return _index(spark, sf_dir).locate(WORD)


def gram_locate_long(spark, sf_dir):
    return _index(spark, sf_dir).locate(LONG)


def gram_locate_short(spark, sf_dir):
    return _index(spark, sf_dir).locate("Th")


def gram_starts_with(spark, sf_dir):
    return _index(spark, sf_dir).starting_with(PREFIX)


def gram_ends_with(spark, sf_dir):
    return _index(spark, sf_dir).ending_with(SUFFIX)


def gram_top_documents(spark, sf_dir):
    return _index(spark, sf_dir).top_k(OVERLAPPING, 10)


def turns_count(spark, sf_dir):
    """Counts in conversations, whose key of two columns becomes one id."""
    turns = _table(spark, sf_dir, "conversations")
    return search.counts(turns.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("doc_id"), "text"), "en")


def pages_metacharacters(spark, sf_dir):
    """A pattern of characters that mean something in regular expressions."""
    pages = _table(spark, sf_dir, "pages")
    return search.counts(pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")), "></")


def _sequence(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("value"))


def sequence_access(spark, sf_dir):
    return sequences.access(_sequence(spark, sf_dir), 100)


def sequence_rank(spark, sf_dir):
    return sequences.rank(_sequence(spark, sf_dir), 5, 1000)


def sequence_ranks(spark, sf_dir):
    return sequences.ranks(_sequence(spark, sf_dir))


def sequence_select(spark, sf_dir):
    return sequences.select(_sequence(spark, sf_dir), 5, 2)


def sequence_range(spark, sf_dir):
    return sequences.range_frequencies(_sequence(spark, sf_dir), 100, 1200)


def sequence_top(spark, sf_dir):
    return sequences.top_k(_sequence(spark, sf_dir), 100, 1200, 5)


def sequence_shape(spark, sf_dir):
    return sequences.shape(_sequence(spark, sf_dir))


def sequence_values(spark, sf_dir):
    return sequences.values(_sequence(spark, sf_dir))


def sequence_starts(spark, sf_dir):
    return sequences.run_starts(_sequence(spark, sf_dir))


def _names(spark, sf_dir):
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))


def suffix_array(spark, sf_dir):
    return suffixes.suffix_array(_names(spark, sf_dir))


def burrows_wheeler(spark, sf_dir):
    return suffixes.transform(_names(spark, sf_dir))


def symbols_less(spark, sf_dir):
    return suffixes.c_table(suffixes.transform(_names(spark, sf_dir)))


def last_to_first(spark, sf_dir):
    return suffixes.lf_mapping(suffixes.transform(_names(spark, sf_dir)))


def inverse_transform(spark, sf_dir):
    return suffixes.inverse(suffixes.transform(_names(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    skip = {"queries", "oracle_sql"}
    return {k: f for k, f in globals().items() if callable(f) and not k.startswith("_") and k[0].islower() and k not in skip and getattr(f, "__module__", "") == __name__}


def _positions(pattern: str, where: str = "true", table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """Offsets from 0 of overlapping occurrences, as a CTE p."""
    return f"""
WITH RECURSIVE o(doc_id, text, pos) AS (
  SELECT {key}, {text}, instr({text}, '{pattern}')::BIGINT FROM {table} WHERE contains({text}, '{pattern}') AND {where}
  UNION ALL
  SELECT doc_id, text, pos + instr(substr(text, pos + 1), '{pattern}') FROM o WHERE instr(substr(text, pos + 1), '{pattern}') > 0),
p AS (SELECT doc_id, pos - 1 AS pos FROM o)
"""


_COUNTS = "SELECT doc_id, count(*)::BIGINT AS n FROM p GROUP BY doc_id"
_SEQ = "WITH s AS (SELECT o_orderkey AS pos, o_custkey AS value FROM orders) "
_SUFFIXES = """
WITH s AS (SELECT p_partkey AS doc_id, p_name AS name, unnest(range(0, length(p_name) + 1))::BIGINT AS pos FROM part),
a AS (SELECT row_number() OVER (ORDER BY substr(name, pos + 1), doc_id) - 1 AS sa_rank, doc_id, pos,
  CASE WHEN pos = length(name) THEN 0 ELSE unicode(substr(name, pos + 1, 1)) + 1 END::INTEGER AS symbol,
  CASE WHEN pos = 0 THEN 0 ELSE unicode(substr(name, pos, 1)) + 1 END::INTEGER AS before FROM s)
"""


def oracle_sql() -> dict[str, str]:
    located = lambda p: _positions(p) + "SELECT doc_id, pos FROM p"
    return {
        "count_per_doc": _positions(WORD) + _COUNTS,
        "count_overlap": _positions(OVERLAPPING) + _COUNTS,
        "count_empty": "SELECT doc_id, (length(text) + 1)::BIGINT AS n FROM documents",
        "count_all": _positions(WORD) + "SELECT count(*)::BIGINT AS n FROM p",
        "count_in_doc": _positions("e", f"doc_id = {DOC}") + _COUNTS,
        "top_documents": _positions(WORD) + _COUNTS + " ORDER BY n DESC, doc_id LIMIT 10",
        "locate": located(WORD),
        "locate_overlap": located(OVERLAPPING),
        "locate_by_windows": located(WORD),
        "locate_in_chunks": located(WORD),
        "locate_in_doc": _positions("e", f"doc_id = {DOC}") + "SELECT pos FROM p",
        "locate_empty": "SELECT p_partkey AS doc_id, unnest(range(0, length(p_name) + 1))::BIGINT AS pos FROM part",
        "locate_grouped": _positions(WORD) + "SELECT doc_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM p GROUP BY doc_id",
        "iterated": located(LONG),
        "iterated_in_doc": _positions("e", f"doc_id = {DOC}") + "SELECT pos FROM p",
        "iterated_text": _positions("e", f"doc_id = {DOC}") + "SELECT pos FROM p",
        "copied_names": "SELECT source, r_regionkey::BIGINT AS doc_id, (length(r_name) - length(replace(r_name, 'A', '')))::BIGINT AS n FROM region, (VALUES ('made'), ('copy'), ('deepcopy'), ('pickle')) v(source) WHERE contains(r_name, 'A')",
        "document_starts": "SELECT doc_id, coalesce(sum(length(text) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM documents",
        "contains_substring": f"SELECT doc_id FROM documents WHERE contains(text, '{WORD}')",
        "contains_document": f"SELECT doc_id FROM documents WHERE text = (SELECT text FROM documents WHERE doc_id = {DOC})",
        "starts_with": f"SELECT doc_id FROM documents WHERE starts_with(text, '{PREFIX}')",
        "ends_with": f"SELECT doc_id FROM documents WHERE ends_with(text, '{SUFFIX}')",
        "corpus_stats": "SELECT count(*)::BIGINT AS num_docs, sum(length(text))::BIGINT AS total_num_chars, (floor(log2(max(list_max(list_transform(string_split(text, ''), lambda c: unicode(c)))) + 1)) + 1)::INTEGER AS max_bit FROM documents",
        "items": "SELECT doc_id, text FROM documents",
        "saved_corpus": "SELECT doc_id, text FROM documents",
        "sql_function": _positions(OVERLAPPING) + "SELECT d.doc_id, count(p.pos)::BIGINT AS n FROM documents d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id",
        "sql_table_function": located(OVERLAPPING),
        "gram_locate": located(WORD),
        "gram_locate_long": located(LONG),
        "gram_locate_short": located("Th"),
        "gram_starts_with": f"SELECT doc_id FROM documents WHERE starts_with(text, '{PREFIX}')",
        "gram_ends_with": f"SELECT doc_id FROM documents WHERE ends_with(text, '{SUFFIX}')",
        "gram_top_documents": _positions(OVERLAPPING) + _COUNTS + " ORDER BY n DESC, doc_id LIMIT 10",
        "turns_count": _positions("en", table="conversations", key="conv_id * 1000000 + turn") + _COUNTS,
        "pages_metacharacters": _positions("></", table="pages", key="page_id", text="html") + _COUNTS,
        "sequence_access": _SEQ + "SELECT value FROM s WHERE pos = 100",
        "sequence_rank": _SEQ + "SELECT count(*)::BIGINT AS n FROM s WHERE value = 5 AND pos < 1000",
        "sequence_ranks": _SEQ + "SELECT pos, value, row_number() OVER (PARTITION BY value ORDER BY pos) - 1 AS rank FROM s",
        "sequence_select": _SEQ + "SELECT pos FROM s WHERE value = 5 ORDER BY pos LIMIT 1 OFFSET 1",
        "sequence_range": _SEQ + "SELECT value, count(*)::BIGINT AS n FROM s WHERE pos >= 100 AND pos < 1200 GROUP BY value",
        "sequence_top": _SEQ + "SELECT value, count(*)::BIGINT AS n FROM s WHERE pos >= 100 AND pos < 1200 GROUP BY value ORDER BY n DESC, value LIMIT 5",
        "sequence_shape": _SEQ + "SELECT count(*)::BIGINT AS length, length(bin(max(value)::BIGINT))::INTEGER AS max_bit FROM s",
        "sequence_values": _SEQ + "SELECT pos, value FROM s",
        "sequence_starts": _SEQ + ", g AS (SELECT value, count(*)::BIGINT AS n FROM s GROUP BY value) SELECT value, n, coalesce(sum(n) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS less FROM g",
        "suffix_array": _SUFFIXES + "SELECT sa_rank, doc_id, pos, symbol FROM a",
        "burrows_wheeler": _SUFFIXES + "SELECT sa_rank, doc_id, pos, before AS symbol FROM a",
        "symbols_less": _SUFFIXES + ", g AS (SELECT before AS symbol, count(*)::BIGINT AS n FROM a GROUP BY before) SELECT symbol, n, coalesce(sum(n) OVER (ORDER BY symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS less FROM g",
        "last_to_first": _SUFFIXES + "SELECT a.sa_rank, b.sa_rank AS lf FROM a JOIN a b ON a.doc_id = b.doc_id AND b.pos = CASE WHEN a.pos = 0 THEN (SELECT length(p_name) FROM part WHERE p_partkey = a.doc_id) ELSE a.pos - 1 END",
        "inverse_transform": "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS doc, p_name AS text FROM part",
    }
