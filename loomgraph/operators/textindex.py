"""Inverted text index with weighted BM25, for many queries in one job."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import porter
from loomgraph.functions.text import col
from loomgraph.operators.skew import is_broadcast, salted_join
from loomgraph.session import materialize

# Published BM25 defaults.
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6


def _accent_table() -> tuple[str, str]:
    """Latin letters with marks and their base letters, derived from Unicode decompositions."""
    plain = {}
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        base = "".join(p for p in parts if not unicodedata.combining(p))
        if len(base) == 1 and base != letter:
            plain[letter] = base
    return "".join(plain), "".join(plain.values())


ACCENTED, PLAIN = _accent_table()


def tokens(c: Column | str) -> Column:
    """Lower-case words without accents: runs of letters, digits and private-use characters."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    bare = F.regexp_replace(F.translate(low, ACCENTED, PLAIN), r"\p{Mn}", "")
    every = F.regexp_extract_all(bare, F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))
    # one byte per character: nothing to fold, and only these letters
    plain = F.octet_length(low) == F.length(low)
    return F.when(plain, F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))).otherwise(every)


@F.pandas_udf(T.StringType())
def stem_word(words: pd.Series) -> pd.Series:
    """Porter stems of words."""
    return words.map(porter.stem, na_action="ignore")


#: Asked words, or ranges of them, that are handed to the scan as literals; the join selects in any case.
PUSHED_WORDS = 1000
PUSHED_RANGES = 32
#: A segment is merged with the one before it if that is not this many times larger.
TIER = 4
#: Bytes of texts whose words are grouped at once, or one text.
BATCH_BYTES = 16 << 20

POSTING = ("doc_id", "n_tokens", "field", "pos", "token")
PACKED = ("doc_id", "n_tokens", "field", "token", "positions")


@dataclass(frozen=True)
class Segment:
    """A part of an index that is never changed.

    ``postings`` has a row per word occurrence (POSTING), ``docs`` doc_id and
    n_tokens, ``words`` the token and stem of the words no earlier segment has,
    ``gone`` the doc_id of documents that it takes out of all earlier segments.
    Of a stored one the postings are sorted by word and their number is known;
    ``packed`` is its table, with one row per word of a field (PACKED).
    """

    postings: DataFrame
    docs: DataFrame
    words: DataFrame
    gone: DataFrame | None = None
    size: int | None = None
    packed: DataFrame | None = None


@dataclass(frozen=True)
class TextIndex:
    """Words of every document as segments, the oldest first.

    Postings hold the words as they are written; a stemmed search looks up the
    words of a stem in the dictionary, so that only distinct words are stemmed.
    """

    segments: tuple[Segment, ...]
    stem: bool = False

    def _live(self, part: Callable[[Segment], DataFrame]) -> DataFrame:
        """The rows of all segments without documents that later ones take out."""
        parts: list[DataFrame] = []
        dead: DataFrame | None = None
        for segment in reversed(self.segments):
            rows = part(segment)
            parts.append(rows if dead is None else rows.join(dead, "doc_id", "left_anti").select(*rows.columns))
            if segment.gone is not None:
                dead = segment.gone if dead is None else dead.unionByName(segment.gone)
        return reduce(DataFrame.unionByName, reversed(parts))

    @property
    def postings(self) -> DataFrame:
        """One row per word occurrence: (doc_id, n_tokens, field, pos, token)."""
        if all(s.packed is not None for s in self.segments):
            return _unpacked(self._live(lambda s: s.packed))
        return self._live(lambda s: s.postings)

    @property
    def docs(self) -> DataFrame:
        """(doc_id, n_tokens) over all fields."""
        return self._live(lambda s: s.docs)

    @property
    def vocabulary(self) -> DataFrame:
        """The distinct words and their stems (token, stem), also those of documents that are gone."""
        return reduce(DataFrame.unionByName, [s.words for s in self.segments])

    def stored(self) -> TextIndex:
        """The index as tables: one segment with its occurrences sorted by word; a frequent word spans several files."""
        grouped = self.postings.groupBy("doc_id", "n_tokens", "field", "token").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
        return TextIndex((_stored(grouped.select(*PACKED), self.docs, self.vocabulary),), self.stem)

    def occurrences(self, wanted: DataFrame) -> DataFrame:
        """The postings that may match ``wanted`` (token); of stored segments only the row groups around them are read."""
        if any(s.size is None for s in self.segments):
            return self.postings
        chosen = word_filter(wanted)
        return self._live(lambda s: s.postings.where(chosen))


def word_filter(wanted: DataFrame, column: str = "token", beyond: str = "") -> Column:
    """A condition on ``column`` that all words (token) of ``wanted`` meet: the words, or if they are many, ranges of them.

    Ranges are those of words that begin alike, neighbours put together until
    they are PUSHED_RANGES at most.  With ``beyond``, what sorts after all that may
    follow a word, they also hold all that begins with one of the words.
    """
    if not beyond:
        few = [r.token for r in wanted.select("token").distinct().limit(PUSHED_WORDS + 1).collect()]
        if len(few) <= PUSHED_WORDS:
            return F.col(column).isin(*few)
    end = F.concat("token", F.lit(beyond))
    for letters in (3, 2, 1):
        ends = wanted.groupBy(F.substring("token", 1, letters)).agg(F.min("token").alias("low"), F.max(end).alias("high"))
        ranges = sorted((r.low, r.high) for r in ends.select("low", "high").where("low IS NOT NULL").limit(PUSHED_WORDS + 1).collect())
        if len(ranges) <= PUSHED_WORDS or letters == 1:
            break
    if not ranges:
        return F.lit(False)
    if len(ranges) > PUSHED_WORDS:  # more first letters than that
        ranges = [tuple(wanted.agg(F.min("token"), F.max(end)).first())]
    together = -(-len(ranges) // PUSHED_RANGES)
    groups = [ranges[i : i + together] for i in range(0, len(ranges), together)]
    return _within(F.col(column), [(group[0][0], max(high for _, high in group)) for group in groups])


def _within(word: Column, ranges: list[tuple[str, str]]) -> Column:
    """Whether a word is in one of the sorted ranges, as a balanced tree: a word outside of what a branch spans skips the branch."""
    span = word.between(ranges[0][0], max(high for _, high in ranges))
    if len(ranges) == 1:
        return span
    half = len(ranges) // 2
    return span & (_within(word, ranges[:half]) | _within(word, ranges[half:]))


def _unpacked(packed: DataFrame) -> DataFrame:
    """One row per word occurrence (POSTING)."""
    return packed.select("doc_id", "n_tokens", "field", F.explode("positions").alias("pos"), "token")


def _packer(fields: Sequence[str]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in fields:
                rows = batch.filter(pc.not_equal(batch.column(f"t_{name}"), ""))
                if not rows.num_rows:
                    continue
                words = pc.split_pattern(rows.column(f"t_{name}"), " ")
                sizes = pc.list_value_length(words).to_numpy()
                doc = np.repeat(np.arange(len(sizes)), sizes)
                pos = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                coded = words.flatten().dictionary_encode()
                key = doc * len(coded.dictionary) + coded.indices.to_numpy()
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(pos[order], pa.int32()))
                at = pa.array(doc[order][first])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(at), rows.column("n_tokens").take(at), pa.array([name]).take(pa.array(np.zeros(len(at), np.int64))),
                     coded.dictionary.take(coded.indices.take(pa.array(order[first]))), lists],
                    names=list(PACKED),
                )

    return pack


def _pack(texts: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A row per word of a field of a text (PACKED) from its words with blanks between, t_<field>; texts are grouped where they are read."""
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_packer(fields), f"doc_id {kind}, n_tokens int, field string, token string, positions array<int>")


def _stored(packed: DataFrame, docs: DataFrame, words: DataFrame, gone: DataFrame | None = None) -> Segment:
    """A segment written as tables, from its PACKED rows."""
    rows = packed.repartitionByRange("token", "doc_id").sortWithinPartitions("token", "doc_id")
    clustered, documents = materialize(rows, "postings"), materialize(docs, "index-docs")
    return Segment(
        _unpacked(clustered), documents, materialize(words, "dictionary"),
        None if gone is None else materialize(gone, "index-gone"), _size(documents), clustered,
    )


def _size(docs: DataFrame) -> int:
    """Word occurrences of the documents."""
    return docs.agg(F.sum("n_tokens")).first()[0] or 0


def _segment(rows: DataFrame, doc_id: str, fields: Mapping[str, Column | str], stem: bool, known: DataFrame | None = None, stored: bool = False) -> Segment:
    """A segment of the given text columns; ``known`` (token) are words that are in the dictionary already."""
    words = rows.select(F.col(doc_id).alias("doc_id"), *[tokens(c).alias(f"w_{name}") for name, c in fields.items()])
    total = reduce(Column.__add__, [F.size(f"w_{name}") for name in fields], F.lit(0)).alias("n_tokens")
    packed = None
    if stored:  # tokenised once, and kept as one text, which is written much faster than an array of words
        texts = materialize(words.select("doc_id", total, *[F.array_join(f"w_{name}", " ").alias(f"t_{name}") for name in fields]), "index-texts")
        packed = _pack(texts, list(fields))
        none = F.array().cast("array<string>")
        split = [F.when(F.col(f"t_{name}") != "", F.split(f"t_{name}", " ")).otherwise(none).alias(f"w_{name}") for name in fields]
        words = texts.select("doc_id", "n_tokens", *split)
    else:
        words = texts = words.select("doc_id", total, *[f"w_{name}" for name in fields])
    parts = F.array(*[F.struct(F.lit(name).alias("field"), F.col(f"w_{name}").alias("words")) for name in fields])
    postings = words.select("doc_id", "n_tokens", F.explode(parts).alias("f")).select(
        "doc_id", "n_tokens", "f.field", F.posexplode("f.words").alias("pos", "token")
    )
    fresh = (postings if packed is None else packed).select("token").distinct()
    if known is not None:
        fresh = fresh.join(known, "token", "left_anti")
    dictionary = fresh.withColumn("stem", stem_word("token") if stem else F.col("token"))
    return Segment(postings, texts.select("doc_id", "n_tokens"), dictionary, packed=packed)


def build_index(
    rows: DataFrame, doc_id: str, fields: Mapping[str, Column | str], stem: bool = False, stored: bool = False, once: bool = False,
) -> TextIndex:
    """Index of the given text columns; ``fields`` maps field names to columns.

    A ``stored`` one is sorted by word, for many searches.  One for a single batch
    of searches (``once``) keeps the words of each text and the dictionary as
    tables, and reads the texts' words in their order.
    """
    part = _segment(rows, doc_id, fields, stem, stored=stored or once)
    if once:
        part = replace(part, words=materialize(part.words, "dictionary"), packed=None)
    elif stored:
        # the words come from the sorted table, not from the texts again
        bare = _stored(part.packed, part.docs, part.words.where("false"))
        words = bare.packed.select("token").distinct().withColumn("stem", stem_word("token") if stem else F.col("token"))
        part = replace(bare, words=materialize(words, "dictionary"))
    return TextIndex((part,), stem)


def update_index(
    index: TextIndex, changed: DataFrame, removed: DataFrame, doc_id: str, fields: Mapping[str, Column | str]
) -> TextIndex:
    """Index after replacing the ``changed`` rows and dropping the ``removed`` ids.

    The changed rows are a new segment, which takes the old versions out; only
    words that are new to the dictionary are stemmed.  Segments are merged when
    the one before is not TIER times larger, so that their number grows with the
    logarithm of the index and a row is rewritten that often.
    """
    gone = changed.select(F.col(doc_id).alias("doc_id")).unionByName(removed.select(F.col(doc_id).alias("doc_id"))).distinct()
    base = index if all(s.size is not None for s in index.segments) else index.stored()
    part = _segment(changed, doc_id, fields, index.stem, base.vocabulary.select("token"), stored=True)
    older, merged = list(base.segments), [replace(part, gone=materialize(gone, "index-gone"))]
    size = _size(part.docs)
    # what is to be merged follows from the documents, so that every row is written once
    while older and older[-1].size <= TIER * size:
        merged.insert(0, older.pop())
        size = _size(TextIndex(tuple(merged)).docs)
    new, out = TextIndex(tuple(merged), index.stem), [s.gone for s in merged if s.gone is not None]
    packed = new._live(lambda s: s.packed)
    dead = reduce(DataFrame.unionByName, out).distinct() if older else None
    return TextIndex((*older, _stored(packed, new.docs, new.vocabulary, dead)), index.stem)


def _expand(parts: DataFrame, vocabulary: DataFrame, stem: bool) -> DataFrame:
    """Replace stems by their words, and prefixes by the words whose stems start with them.

    Equi-joins: every vocabulary word offers the prefixes of its stem as keys,
    but only those that some query asks for.
    """
    keep = ["query_id", "term_no", "n_parts", "off"]
    exact = parts.where("NOT is_prefix").select(*keep, "token")
    if stem:
        exact = vocabulary.join(exact.withColumnRenamed("token", "stem"), "stem").select(*keep, "token")
    asked = parts.where("is_prefix").withColumnRenamed("token", "prefix")
    # Only prefixes of an asked length are offered; a query text bounds their number.
    sizes = asked.agg(F.collect_set(F.length("prefix"))).scalar()
    cuts = F.transform(
        F.filter("sizes", lambda n: n <= F.length("stem")), lambda n: F.substring(F.col("stem"), F.lit(1), n)
    )
    offers = vocabulary.withColumn("sizes", sizes).select("token", F.explode(cuts).alias("prefix")).join(
        asked.select("prefix").distinct(), "prefix", "left_semi"
    )
    return exact.unionByName(offers.join(asked, "prefix").select(*keep, "token"))


def match_terms(index: TextIndex, terms: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """(query_id, term_no, doc_id, tf, n_tokens): weighted hits of each query term.

    ``terms`` has query_id, term_no, words ARRAY<STRING>, is_prefix.  A term
    with several words is a phrase; a prefix flag belongs to its last word.
    """
    parts = terms.select(
        "query_id", "term_no", F.size("words").alias("n_parts"), "is_prefix",
        F.posexplode("words").alias("off", "token"),
    ).withColumn("is_prefix", F.col("is_prefix") & (F.col("off") == F.col("n_parts") - 1))
    if index.stem:
        parts = parts.withColumn("token", stem_word("token"))
    wanted = materialize(_expand(parts, index.vocabulary, index.stem), "search-words")
    weight = F.lit(0.0)
    for name, value in weights.items():
        weight = F.when(F.col("field") == name, float(value)).otherwise(weight)
    occurrences = index.occurrences(wanted)
    if is_broadcast(wanted):
        hits = occurrences.join(wanted, "token")
    else:
        hits = salted_join(occurrences, wanted, ["token"], spread_by=["doc_id"])
    begin = F.when(F.col("n_parts") > 1, F.col("pos") - F.col("off"))
    counted = hits.groupBy("query_id", "term_no", "n_parts", "doc_id", "n_tokens", "field", begin.alias("begin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    found = F.when(F.col("n_parts") == 1, F.col("n")).when(F.col("n") == F.col("n_parts"), 1)
    return (
        counted.withColumn("found", found)
        .where("found IS NOT NULL")
        .groupBy("query_id", "term_no", "doc_id")
        .agg(F.sum(weight * F.col("found")).alias("tf"), F.max("n_tokens").alias("n_tokens"))
    )


def bm25(index: TextIndex, terms: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """(query_id, doc_id, bm25) of the documents that match every term, higher is better.

    A term's document frequency counts all documents that hold it; lengths
    count the words of all fields.
    """
    hits = materialize(match_terms(index, terms, weights), "term-hits")
    frequency = hits.groupBy("query_id", "term_no").agg(F.count(F.lit(1)).alias("df"))
    needed = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
    corpus = index.docs.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("words")).alias("c")
    ).scalar()
    scored = (
        hits.join(frequency, ["query_id", "term_no"])
        .withColumn("n_docs", corpus["n"].cast("double"))
        .withColumn("mean", corpus["words"].cast("double") / corpus["n"])
    )
    idf = F.greatest(F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("n_tokens") / F.col("mean"))
    return (
        scored.withColumn("part", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm))
        .groupBy("query_id", "doc_id")
        .agg(F.sum("part").alias("bm25"), F.count(F.lit(1)).alias("n_hit"))
        .join(needed, "query_id")
        .where("n_hit = n_terms")
        .select("query_id", "doc_id", "bm25")
    )
