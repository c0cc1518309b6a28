"""Symbol lookup by name or FQN, for one constant or for a table of queries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import ascii_lower
from loomgraph.operators.skew import salted_join
from loomgraph.operators.textindex import word_filter
from loomgraph.session import materialize

CALLABLE_KINDS = ("function", "method")
#: Longest substring that names are looked up by; a longer text is looked up by its rarest one of this length.
GRAM = 16
#: Sorts after all that a name may go on with.
LAST = "\U0010ffff" * GRAM

PUBLIC_FIELDS = (
    "id", "repo_id", "file_id", "lang", "kind", "name", "fqn", "signature", "visibility",
    "start_line", "start_col", "end_line", "end_col", "start_byte", "end_byte",
)


def public_symbols(symbols: DataFrame) -> DataFrame:
    """The public columns only; missing texts read as empty."""
    present = [c for c in PUBLIC_FIELDS if c in symbols.columns]
    texts = {"fqn", "signature", "visibility"}
    return symbols.select(*[F.coalesce(c, F.lit("")).alias(c) if c in texts else F.col(c) for c in present])


def by_fqn(symbols: DataFrame, fqn: str) -> DataFrame:
    return symbols.where(F.col("fqn") == fqn)


def by_name(symbols: DataFrame, text: str) -> DataFrame:
    """Name contains ``text``, ASCII case folded, wildcards taken literally."""
    return symbols.where(F.contains(ascii_lower("name"), ascii_lower(F.lit(text))))


def by_id(symbols: DataFrame, ids: DataFrame) -> DataFrame:
    return symbols.join(ids.select("id").distinct(), "id", "left_semi")


def repo_by_path(repos: DataFrame, root_path: str) -> DataFrame:
    return repos.where(F.col("root_path") == root_path)


def files_of_repo(files: DataFrame, repo_id: int) -> DataFrame:
    return files.where(F.col("repo_id") == repo_id)


def file_by_path(files: DataFrame, repo_id: int, path: str) -> DataFrame:
    return files_of_repo(files, repo_id).where(F.col("path") == path)


def fqn_ids(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """(repo_id, query, id): smallest symbol id per exact FQN, 0 if there is none."""
    wanted = queries.select("repo_id", "query").distinct()
    found = (
        symbols.select("repo_id", F.col("fqn").alias("query"), "id")
        .join(wanted, ["repo_id", "query"], "left_semi")
        .groupBy("repo_id", "query")
        .agg(F.min("id").alias("id"))
    )
    return wanted.join(found, ["repo_id", "query"], "left").withColumn("id", F.coalesce("id", F.lit(0)))


def _grams(text, size):
    """All substrings of ``text`` with the given length (none if it is shorter)."""
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))),
        lambda i: F.substring(text, i, size),
    )


def _suffixes(names: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Every name from each of its characters on, GRAM of them: (keys..., name, __at, __rest); an empty name once."""
    places = names.where(F.col(name).isNotNull()).select(
        *keys, name, F.explode(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1)))).alias("__at")
    )
    return places.withColumn("__rest", F.substring(ascii_lower(name), F.col("__at"), F.lit(GRAM)))


def _substrings(rests: DataFrame, grams: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """(keys..., name, __gram): the names that hold the asked substrings (keys..., __gram), each pair once.

    Substrings are made only of the lengths that are asked for, and each where it
    first stands in the name.
    """
    sizes = materialize(grams.groupBy(*keys).agg(F.collect_set(F.length("__gram")).alias("__sizes")), "gram-sizes")  # of GRAM + 1 at most
    fits = F.filter("__sizes", lambda n: (n <= F.length("__rest")) & ((n > 0) | (F.col("__at") == 1)))
    heads = F.transform(fits, lambda n: F.substring(F.col("__rest"), F.lit(1), n))
    offers = rests.join(sizes, list(keys)).select(*keys, name, "__at", F.explode(heads).alias("__gram"))
    first = offers.where(F.position("__gram", ascii_lower(name)) == F.col("__at")).drop("__at")
    return first.join(grams.select(*keys, "__gram").distinct(), [*keys, "__gram"], "left_semi")


@dataclass(frozen=True)
class NameIndex:
    """The distinct names of a symbol table, stored from each of their characters on, sorted by what follows."""

    postings: DataFrame
    keys: tuple[str, ...]
    name: str


def index_names(haystack: DataFrame, keys: Sequence[str] = ("repo_id",), name: str = "name") -> NameIndex:
    """The index that ``contains_join`` and what builds on it take; made once for many lookups."""
    rows = _suffixes(haystack.select(*keys, name).distinct(), keys, name)
    postings = materialize(rows.repartitionByRange("__rest", *keys, name).sortWithinPartitions("__rest"), "name-postings")
    return NameIndex(postings, tuple(keys), name)


def contains_join(
    needles: DataFrame, haystack: DataFrame, keys: Sequence[str] = ("repo_id",),
    needle: str = "query", name: str = "name", index: NameIndex | None = None,
) -> DataFrame:
    """Pairs (keys..., needle, name) where the name contains the needle, ASCII case folded.

    Not a nested loop: a needle of at most GRAM characters meets the names under
    itself, as one of their substrings of its length.  A longer one picks its
    rarest substring of GRAM characters, and only names that hold that one are
    compared with it.  With an ``index`` of the names only the row groups around
    the asked substrings are read.
    """
    keys = list(keys)
    wanted = needles.select(*keys, needle).distinct().withColumn("__needle", ascii_lower(needle))
    size = F.least(F.length("__needle"), F.lit(GRAM))
    needle_grams = materialize(wanted.select(
        *keys, needle, "__needle", F.explode(F.array_distinct(_grams(F.col("__needle"), size))).alias("__gram")
    ), "needle-grams")
    if index is None:
        rests = _suffixes(haystack.select(*keys, name).distinct(), keys, name)
    else:
        rests = index.postings.where(word_filter(needle_grams.select(F.col("__gram").alias("token")), "__rest", LAST))
    name_grams = materialize(_substrings(rests, needle_grams, keys, name), "name-grams")
    counts = name_grams.groupBy(*keys, "__gram").agg(F.count(F.lit(1)).alias("__names"))
    rarest = (
        needle_grams.join(counts, [*keys, "__gram"], "left")
        .groupBy(*keys, needle, "__needle")
        .agg(F.min(F.struct(F.coalesce("__names", F.lit(0)).alias("n"), F.col("__gram").alias("gram"))).alias("best"))
        .select(*keys, needle, "__needle", F.col("best.gram").alias("__gram"))
    )
    return (
        salted_join(name_grams, rarest, [*keys, "__gram"])
        .where(F.contains(ascii_lower(name), "__needle"))
        .select(*keys, needle, name)
    )


def name_matches(symbols: DataFrame, queries: DataFrame, index: NameIndex | None = None) -> DataFrame:
    """Contains-matches of many queries: (repo_id, query, id, kind, name, fqn)."""
    pairs = contains_join(queries, symbols, index=index)
    fields = symbols.select("repo_id", "id", "kind", "name", F.coalesce("fqn", F.lit("")).alias("fqn"))
    return salted_join(fields, pairs, ["repo_id", "name"])


def query_symbols(symbols: DataFrame, queries: DataFrame, index: NameIndex | None = None) -> DataFrame:
    """FQN hits if the text has a dot and there are any, else contains-matches.

    Returns (repo_id, query, id, kind, name, fqn).
    """
    wanted = queries.select("repo_id", "query").distinct()
    fields = symbols.select("repo_id", "id", "kind", "name", "fqn")
    exact = fields.join(
        wanted.where(F.contains("query", F.lit("."))).withColumnRenamed("query", "fqn"), ["repo_id", "fqn"]
    ).withColumn("query", F.col("fqn"))
    rest = wanted.join(exact.select("repo_id", "query").distinct(), ["repo_id", "query"], "left_anti")
    return exact.select("repo_id", "query", "id", "kind", "name", "fqn").unionByName(
        name_matches(symbols, rest, index)
    )


def resolve_names(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """One symbol per name or FQN, or the reason why there is none.

    Returns (repo_id, query, symbol_id, status, candidates); status is fqn,
    single, exact, callable, ambiguous or not_found and ``candidates`` counts
    the contains-matches.  ``ambiguous_candidates`` lists them.
    """
    wanted = queries.select("repo_id", "query").distinct()
    by_fqn_id = (
        symbols.select("repo_id", F.col("fqn").alias("query"), "id")
        .join(wanted, ["repo_id", "query"], "left_semi")
        .groupBy("repo_id", "query")
        .agg(F.min("id").alias("fqn_id"))
    )
    rest = wanted.join(by_fqn_id, ["repo_id", "query"], "left_anti")
    same = F.col("name") == F.col("query")
    runs = same & F.col("kind").isin(*CALLABLE_KINDS)
    ladder = (
        name_matches(symbols, rest)
        .groupBy("repo_id", "query")
        .agg(
            F.count(F.lit(1)).alias("candidates"),
            F.min("id").alias("any_id"),
            F.count_if(same).alias("n_same"),
            F.min(F.when(same, F.col("id"))).alias("same_id"),
            F.count_if(runs).alias("n_runs"),
            F.min(F.when(runs, F.col("id"))).alias("runs_id"),
        )
    )
    status = (
        F.when(F.col("fqn_id").isNotNull(), "fqn")
        .when(F.col("candidates").isNull(), "not_found")
        .when(F.col("candidates") == 1, "single")
        .when(F.col("n_same") == 1, "exact")
        .when(F.col("n_runs") == 1, "callable")
        .otherwise("ambiguous")
    )
    chosen = (
        F.when(F.col("status") == "fqn", F.col("fqn_id"))
        .when(F.col("status") == "single", F.col("any_id"))
        .when(F.col("status") == "exact", F.col("same_id"))
        .when(F.col("status") == "callable", F.col("runs_id"))
    )
    return (
        wanted.join(by_fqn_id, ["repo_id", "query"], "left")
        .join(ladder, ["repo_id", "query"], "left")
        .withColumn("status", status)
        .select(
            "repo_id", "query", chosen.alias("symbol_id"), "status",
            F.coalesce("candidates", F.lit(0)).alias("candidates"),
        )
    )


def ambiguous_candidates(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """The symbols between which an ambiguous name leaves the choice: (repo_id, query, id, kind, fqn), a row each."""
    unclear = resolve_names(symbols, queries).where("status = 'ambiguous'").select("repo_id", "query")
    return name_matches(symbols, materialize(unclear, "ambiguous")).select("repo_id", "query", "id", "kind", "fqn")
