"""Storing and updating notes: validation, normalisation, duplicate rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import (
    col,
    content_hash,
    normalize_scope,
    normalize_tags,
    normalize_title,
    trim_space,
)
from loomgraph.operators.grouping import connected
from loomgraph.operators.skew import salted_join
from loomgraph.session import materialize

# Limits, patterns and phrases of the note validation.
TITLE_MIN, TITLE_MAX = 10, 100
CONTENT_MIN, CONTENT_MAX = 50, 5000
TAGS_MAX = 10
SCOPE_PATTERN = r"(?iu)^(global|project:[a-z0-9_-]+|repo:[a-z0-9_-]+)\z"
TAG_PATTERN = r"(?iu)^[a-z0-9][a-z0-9-]*\z"
GENERIC_PHRASES = (
    "this is important",
    "remember this",
    "note to self",
    "todo",
    "fix this",
    "do this",
    "always do",
    "never do",
)
DUPLICATE_TITLE = "knowledge with similar title already exists in this scope"
DUPLICATE_CONTENT = "knowledge with identical content already exists in this scope"
NOT_FOUND = "knowledge item not found"
STORED = "knowledge stored successfully"
UPDATED = "knowledge updated successfully"

COLUMNS = ("id", "title", "content", "tags", "scope", "normalized_title", "content_hash", "created_at", "updated_at")
NO_ERRORS = "array<string>"


def _messages(*tests: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(test, F.lit(text)) for test, text in tests]), lambda e: e.isNotNull())


def title_errors(title: Column | str) -> Column:
    """Lengths are in bytes, after trimming."""
    t = trim_space(F.coalesce(col(title), F.lit("")))
    return F.when(t == "", F.array(F.lit("title is required"))).otherwise(
        _messages(
            (F.octet_length(t) < TITLE_MIN, "title must be at least 10 characters"),
            (F.octet_length(t) > TITLE_MAX, "title must be at most 100 characters"),
        )
    )


def content_errors(content: Column | str) -> Column:
    c = trim_space(F.coalesce(col(content), F.lit("")))
    # A generic note starts with one of the phrases, alone or before a blank.
    longest = max(map(len, GENERIC_PHRASES)) + 1
    generic = F.lower(F.substring(c, 1, longest)).rlike(r"\A(?:" + "|".join(GENERIC_PHRASES) + r")(?: |\z)")
    size = F.octet_length(c)
    return F.when(c == "", F.array(F.lit("content is required"))).otherwise(
        _messages(
            (size < CONTENT_MIN, "content must be at least 50 characters"),
            (size > CONTENT_MAX, "content must be at most 5000 characters"),
            (generic, "content appears too generic; provide specific, actionable knowledge"),
        )
    )


def tag_errors(tags: Column | str) -> Column:
    t = F.coalesce(col(tags), F.array().cast("array<string>"))
    bad = F.transform(
        F.filter(t, lambda x: ~x.rlike(TAG_PATTERN)),
        lambda x: F.concat(F.lit('invalid tag "'), x, F.lit('": tags must be alphanumeric with hyphens')),
    )
    return F.concat(_messages((F.size(t) > TAGS_MAX, "maximum 10 tags allowed")), bad)


def scope_errors(scope: Column | str) -> Column:
    s = F.coalesce(col(scope), F.lit(""))
    return _messages(
        (
            (s != "") & ~s.rlike(SCOPE_PATTERN),
            'invalid scope: must be "global", "project:<name>", or "repo:<name>"',
        )
    )


def store_errors() -> Column:
    """All errors of a store request (title, content, tags, scope)."""
    return F.concat(title_errors("title"), content_errors("content"), tag_errors("tags"), scope_errors("scope"))


def update_errors() -> Column:
    """All errors of an update request; only given fields are checked."""
    none = F.array().cast(NO_ERRORS)
    tags_given = F.coalesce("tags_provided", F.lit(False))
    given = F.col("title").isNotNull() | F.col("content").isNotNull() | tags_given | F.col("scope").isNotNull()
    return F.concat(
        _messages(
            (trim_space(F.coalesce("id", F.lit(""))) == "", "id is required"),
            (~given, "at least one of title, content, tags, or scope must be provided"),
        ),
        F.when(F.col("title").isNotNull(), title_errors("title")).otherwise(none),
        F.when(F.col("content").isNotNull(), content_errors("content")).otherwise(none),
        F.when(tags_given, tag_errors("tags")).otherwise(none),
        F.when(F.col("scope").isNotNull(), scope_errors("scope")).otherwise(none),
    )


def as_notes(requests: DataFrame) -> DataFrame:
    """Valid store requests as note rows; the request id becomes the note id."""
    return requests.select(
        F.col("req_id").alias("id"),
        trim_space("title").alias("title"),
        trim_space("content").alias("content"),
        normalize_tags("tags").alias("tags"),
        normalize_scope("scope").alias("scope"),
        normalize_title("title").alias("normalized_title"),
        content_hash("content").alias("content_hash"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
    )


def title_duplicates(existing: DataFrame, notes: DataFrame) -> DataFrame:
    """(id, existing_id): notes whose normalised title is taken inside their scope."""
    return _taken(existing, notes, "normalized_title")


def content_duplicates(existing: DataFrame, notes: DataFrame) -> DataFrame:
    """(id, existing_id): notes whose content hash is taken inside their scope."""
    return _taken(existing, notes, "content_hash")


def _taken(existing: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    holders = existing.groupBy(key, "scope").agg(F.min("id").alias("existing_id"))
    return salted_join(notes.select("id", key, "scope"), holders, [key, "scope"], spread_by=["id"]).where(
        "id <> existing_id"
    ).select("id", "existing_id")


TITLE_KEY, CONTENT_KEY = ["scope", "normalized_title"], ["scope", "content_hash"]
#: Notes that one task decides in their order.
TOGETHER = 50_000


def _accepted(notes: DataFrame, existing: DataFrame) -> DataFrame:
    """Ids of the notes a one-by-one pass in (created_at, id) order would store.

    A note is stored if no stored note has its title or its content in its
    scope.  Notes that come first on both of their keys are stored and what
    shares a key with them is closed, which decides most.  The others are decided
    in their order: in one task if they are TOGETHER at most, else by groups
    connected by keys, which do not depend on each other, many in one task; larger
    groups go on round by round.
    """
    # Later copies of the same (title, content) can never be stored.
    open_ = (
        notes.groupBy("scope", "normalized_title", "content_hash")
        .agg(F.min(F.struct("created_at", "id")).alias("ord"))
        .join(existing.select(*TITLE_KEY).distinct(), TITLE_KEY, "left_anti")
        .join(existing.select(*CONTENT_KEY).distinct(), CONTENT_KEY, "left_anti")
    )
    stored, open_ = _first_on_both(materialize(open_, "open-notes"))
    left = open_.count()
    if left > TOGETHER:
        title, content = F.xxhash64(F.lit("title"), *TITLE_KEY), F.xxhash64(F.lit("content"), *CONTENT_KEY)
        roots = connected(open_.select(title.alias("a"), content.alias("b")))
        grouped = materialize(open_.withColumn("node", title).join(roots, "node").drop("node"), "grouped-notes")
        large = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TOGETHER).select("root")
        small = grouped.join(large, "root", "left_anti")
        tasks = -(-left // TOGETHER)
        stored = stored.unionByName(_in_order(small.withColumn("task", F.pmod(F.xxhash64("root"), F.lit(4 * tasks)))))
        open_ = materialize(grouped.join(large, "root", "left_semi").drop("root"), "open-notes")
        while not open_.isEmpty():
            more, open_ = _first_on_both(open_)
            stored = stored.unionByName(more)
    elif left:
        stored = stored.unionByName(_in_order(open_.withColumn("task", F.lit(0).cast("long"))))
    return stored


def _first_on_both(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids of the notes that come first on both keys, the notes that share no key with them).

    The earliest open note is always decided, and a stored note never has an
    earlier open rival, so the result is the sequential one.
    """
    by_title = open_.groupBy(*TITLE_KEY).agg(F.min_by("content_hash", "ord").alias("content_hash"), F.min("ord").alias("ord"))
    by_content = open_.groupBy(*CONTENT_KEY).agg(F.min("ord").alias("c_ord"))
    winners = materialize(
        by_title.join(by_content, CONTENT_KEY).where("ord = c_ord").select(*TITLE_KEY, "content_hash", "ord"), "winners"
    )
    rest = open_.join(winners.select(*TITLE_KEY), TITLE_KEY, "left_anti").join(
        winners.select(*CONTENT_KEY).distinct(), CONTENT_KEY, "left_anti"
    )
    return winners.select(F.col("ord.id").alias("id")), materialize(rest, "open-notes")


def _in_order(open_: DataFrame) -> DataFrame:
    """Ids of the notes that a pass in their order stores, for whole groups of notes by ``task``."""

    def run(notes: pd.DataFrame) -> pd.DataFrame:
        titles, contents, ids = set(), set(), []
        for n in notes.sort_values(["created_at", "id"], na_position="first").itertuples(index=False):
            title, content = (n.scope, n.normalized_title), (n.scope, n.content_hash)
            if title not in titles and content not in contents:
                titles.add(title)
                contents.add(content)
                ids.append(n.id)
        return pd.DataFrame({"id": pd.Series(ids, dtype=object)})

    rows = open_.select("task", "scope", "normalized_title", "content_hash", F.col("ord.created_at").alias("created_at"), F.col("ord.id").alias("id"))
    return materialize(rows.groupBy("task").applyInPandas(run, "id string"), "ordered-notes")


def store_batch(existing: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store many requests as if they came one by one in (ts, req_id) order.

    Returns the outcome per request (req_id, code, message, existing_id, field,
    errors) and the new notes.  Codes: OK, VALIDATION_ERROR,
    DUPLICATE_KNOWLEDGE.
    """
    checked = materialize(requests.withColumn("errors", store_errors()), "checked-requests")
    notes = materialize(as_notes(checked.where(F.size("errors") == 0)), "valid-notes")
    added = materialize(notes.join(_accepted(notes, existing), "id", "left_semi").select(*COLUMNS), "added-notes")
    slot = F.struct("created_at", "id")
    holders = added.select("id", "scope", "normalized_title", "content_hash", slot.alias("since")).unionByName(
        existing.select("id", "scope", "normalized_title", "content_hash", F.lit(None).cast(
            added.select(slot.alias("s")).schema["s"].dataType).alias("since"))
    )

    def holder(key: str, name: str) -> DataFrame:
        return holders.select("scope", key, F.struct("id", "since").alias(name))

    judged = salted_join(notes, holder("normalized_title", "by_title"), ["scope", "normalized_title"], "left",
                         spread_by=["id"])
    judged = judged.join(holder("content_hash", "by_content"), ["scope", "content_hash"], "left")

    def blocks(name: str) -> Column:
        h = F.col(name)
        return F.coalesce(
            h["id"].isNotNull() & (h["id"] != F.col("id")) & (h["since"].isNull() | (h["since"] < slot)), F.lit(False)
        )

    field = F.when(blocks("by_title"), "title").when(blocks("by_content"), "content")
    none = F.array().cast(NO_ERRORS)
    valid = judged.withColumn("field", field).select(
        F.col("id").alias("req_id"),
        F.when(F.col("field").isNull(), "OK").otherwise("DUPLICATE_KNOWLEDGE").alias("code"),
        F.when(F.col("field") == "title", DUPLICATE_TITLE)
        .when(F.col("field") == "content", DUPLICATE_CONTENT)
        .otherwise(STORED).alias("message"),
        F.when(F.col("field") == "title", F.col("by_title.id"))
        .when(F.col("field") == "content", F.col("by_content.id")).alias("existing_id"),
        "field",
        none.alias("errors"),
    )
    return valid.unionByName(_rejected(checked)), added


def _rejected(checked: DataFrame) -> DataFrame:
    """Outcome rows of requests that failed validation."""
    return checked.where(F.size("errors") > 0).select(
        "req_id",
        F.lit("VALIDATION_ERROR").alias("code"),
        F.array_join("errors", "; ").alias("message"),
        F.lit(None).cast("string").alias("existing_id"),
        F.lit(None).cast("string").alias("field"),
        "errors",
    )


def fold_patches(patches: DataFrame) -> DataFrame:
    """Patches of one note that all succeed as one patch: the last given value of every field."""
    at = F.struct("ts", "req_id")
    tags_given = F.coalesce("tags_provided", F.lit(False))

    def last(name: str, given: Column) -> Column:
        return F.max_by(F.when(given, F.struct(name)), F.when(given, at)).alias(name)

    return (
        patches.groupBy("id")
        .agg(
            F.max(at).alias("at"),
            last("title", F.col("title").isNotNull()),
            last("content", F.col("content").isNotNull()),
            last("tags", tags_given),
            last("scope", F.col("scope").isNotNull()),
            F.max(tags_given).alias("tags_provided"),
        )
        .select(
            "id", F.col("at.ts").alias("ts"), F.col("at.req_id").alias("req_id"),
            *[F.col(f"{n}.{n}").alias(n) for n in ("title", "content", "tags", "scope")], "tags_provided",
        )
    )


def patched_notes(existing: DataFrame, patches: DataFrame) -> DataFrame:
    """Existing notes with their patch applied and re-normalised, plus the old keys."""
    p = patches.select(
        "id", F.col("ts").alias("p_ts"), "req_id",
        *[F.col(n).alias(f"p_{n}") for n in ("title", "content", "tags", "scope")],
        F.coalesce("tags_provided", F.lit(False)).alias("p_tags_provided"),
    )
    merged = existing.join(p, "id")
    title = F.coalesce(trim_space("p_title"), "title")
    content = F.coalesce(trim_space("p_content"), "content")
    scope = F.when(F.col("p_scope").isNotNull(), normalize_scope("p_scope")).otherwise(F.col("scope"))
    return merged.select(
        "id",
        title.alias("title"),
        content.alias("content"),
        F.when(F.col("p_tags_provided"), normalize_tags("p_tags")).otherwise(F.col("tags")).alias("tags"),
        scope.alias("scope"),
        normalize_title(title).alias("normalized_title"),
        content_hash(content).alias("content_hash"),
        "created_at",
        F.col("p_ts").alias("updated_at"),
        "req_id",
        F.struct("scope", "normalized_title", "content_hash").alias("old"),
    )


def update_batch(existing: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply patches as if they came one by one in (ts, req_id) order.

    Returns the outcomes (req_id, code, message, existing_id, field, errors), one
    per patch, and the whole note table afterwards.  Codes: OK,
    VALIDATION_ERROR, NOT_FOUND, DUPLICATE_KNOWLEDGE.

    Notes whose titles and contents, now and after any of their patches, no other
    note has or may get are patched at once.  The others are decided round by
    round, the earliest open patch of each note at a time: it is judged when no
    earlier open patch of another note may touch its keys, and rejected even
    before that when the note that holds its key has no earlier open patch.  All
    later claimants of a taken key are thus closed in one round.
    """
    checked = patches.withColumn("errors", update_errors())
    valid = materialize(checked.where(F.size("errors") == 0).drop("errors"), "valid-patches")
    none = F.array().cast(NO_ERRORS)
    nothing = F.lit(None).cast("string")
    missing = valid.join(existing.select("id"), "id", "left_anti").select(
        "req_id", F.lit("NOT_FOUND").alias("code"), F.lit(NOT_FOUND).alias("message"),
        nothing.alias("existing_id"), nothing.alias("field"), none.alias("errors"),
    )
    known = valid.join(existing.select("id"), "id", "left_semi")
    values = materialize(_values(existing.join(known.select("id"), "id", "left_semi"), known), "patch-values")
    others = _values(existing, None).join(values.select("what", "value").distinct(), ["what", "value"], "left_semi")
    contested = (
        values.unionByName(others).groupBy("what", "value").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("what", "value")
    )
    contested = materialize(contested, "contested-values")
    linked = materialize(values.join(contested, ["what", "value"], "left_semi").select("id").distinct(), "linked-notes")

    alone = known.join(linked, "id", "left_anti")
    at_once = materialize(patched_notes(existing, fold_patches(alone)).select(*COLUMNS), "patched-notes")
    judged, state = _one_by_one(existing, known.join(linked, "id", "left_semi"), linked, contested)
    judged = alone.select("req_id", nothing.alias("field"), nothing.alias("existing_id")).unionByName(judged)
    outcome = judged.select(
        "req_id",
        F.when(F.col("field").isNull(), "OK").otherwise("DUPLICATE_KNOWLEDGE").alias("code"),
        F.when(F.col("field") == "title", DUPLICATE_TITLE)
        .when(F.col("field") == "content", DUPLICATE_CONTENT)
        .otherwise(UPDATED).alias("message"),
        "existing_id", "field", none.alias("errors"),
    )
    done = at_once.unionByName(state)
    table = existing.join(done.select("id"), "id", "left_anti").select(*COLUMNS).unionByName(done)
    return outcome.unionByName(missing).unionByName(_rejected(checked)), table


def _values(notes: DataFrame, patches: DataFrame | None) -> DataFrame:
    """Distinct (id, what, value): titles and contents that notes have or that their patches give."""
    def both(title: Column, content: Column) -> Column:
        kinds = F.array(F.struct(F.lit("title").alias("what"), title.alias("value")), F.struct(F.lit("content").alias("what"), content.alias("value")))
        return F.explode(F.filter(kinds, lambda k: k["value"].isNotNull())).alias("k")

    found = notes.select("id", both(F.col("normalized_title"), F.col("content_hash")))
    if patches is not None:
        found = found.unionByName(patches.select("id", both(normalize_title(trim_space("title")), content_hash(trim_space("content")))))
    return found.select("id", "k.what", "k.value").distinct()


def _one_by_one(existing: DataFrame, patches: DataFrame, linked: DataFrame, contested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decide the patches of linked notes: (req_id, field, existing_id) per patch, and the notes afterwards."""
    nothing = F.lit(None).cast("string")
    slot = ["what", "scope", "value"]
    open_ = materialize(patches.withColumn("ord", F.struct("ts", "req_id")), "open-patches")
    state = materialize(existing.join(linked, "id", "left_semi").select(*COLUMNS), "linked-state")
    holders = materialize(
        _keys(existing.withColumn("old", F.struct("scope", "normalized_title", "content_hash"))).where("NOT is_old")
        .join(contested, ["what", "value"], "left_semi").select("id", *slot),
        "key-holders",
    )
    judged = open_.where("false").select("req_id", nothing.alias("field"), nothing.alias("existing_id"))
    names = [c for c in open_.columns if c != "id"]
    while not open_.isEmpty():
        head = open_.groupBy("id").agg(F.min_by(F.struct(*names), "ord").alias("p")).select("id", "p.*")
        asked = materialize(patched_notes(state, head).withColumn("ord", F.struct("updated_at", "req_id")), "asked-patches")
        turn = asked.select("id", "ord")
        may = _values(state, open_).join(turn, "id")
        first = may.groupBy("what", "value").agg(F.min("ord").alias("first"))
        keys = _keys(asked)
        waits = keys.join(first, ["what", "value"]).where("ord > first").groupBy("id").agg(
            F.lit(True).alias("waits"), F.max((F.col("what") == "title") & ~F.col("is_old")).alias("title_waits"),
        )
        held = (
            keys.where("NOT is_old").join(holders.withColumnRenamed("id", "existing_id"), slot).where("id <> existing_id")
            .join(turn.select(F.col("id").alias("existing_id"), F.col("ord").alias("holder_turn")), "existing_id", "left")
            .withColumn("stays", F.coalesce(F.col("holder_turn") > F.col("ord"), F.lit(True)))
            .groupBy("id").agg(*[
                F.max_by(F.when(F.col("what") == w, F.struct("existing_id", "stays")), F.when(F.col("what") == w, F.col("existing_id"))).alias(w)
                for w in ("title", "content")
            ])
        )
        view = asked.join(waits, "id", "left").join(held.withColumnsRenamed({"title": "by_title", "content": "by_content"}), "id", "left")
        free = ~F.coalesce("waits", F.lit(False))
        by_title, by_content = F.col("by_title").isNotNull(), F.col("by_content").isNotNull()
        title_sure = by_title & (free | F.col("by_title.stays"))
        content_sure = ~by_title & by_content & (free | (~F.coalesce("title_waits", F.lit(False)) & F.col("by_content.stays")))
        view = view.withColumn("field", F.when(title_sure, "title").when(content_sure, "content")).where(free | F.col("field").isNotNull())
        view = view.withColumn("existing_id", F.when(title_sure, F.col("by_title.existing_id")).when(content_sure, F.col("by_content.existing_id")))
        decided = materialize(view.drop("waits", "title_waits", "by_title", "by_content"), "judged-patches")
        judged = judged.unionByName(decided.select("req_id", "field", "existing_id"))
        applied = decided.where("field IS NULL")
        state = materialize(state.join(applied.select("id"), "id", "left_anti").unionByName(applied.select(*COLUMNS)), "linked-state")
        holders = materialize(
            holders.join(applied.select("id"), "id", "left_anti").unionByName(_keys(applied).where("NOT is_old").select("id", *slot)), "key-holders",
        )
        open_ = materialize(open_.join(decided.select("req_id"), "req_id", "left_anti"), "open-patches")
    return judged, state


def _keys(rows: DataFrame) -> DataFrame:
    """Title and content keys a row holds after (is_old false) and before its patch."""
    def key(what: str, scope: str, value: str, is_old: bool) -> Column:
        return F.struct(
            F.lit(what).alias("what"), F.col(scope).alias("scope"), F.col(value).alias("value"), F.lit(is_old).alias("is_old")
        )

    both = F.array(
        key("title", "scope", "normalized_title", False), key("content", "scope", "content_hash", False),
        key("title", "old.scope", "old.normalized_title", True), key("content", "old.scope", "old.content_hash", True),
    )
    extra = ["ord"] if "ord" in rows.columns else []
    return rows.select("id", *extra, F.explode(both).alias("k")).select("id", *extra, "k.*")


def outcome_envelope(outcomes: DataFrame) -> DataFrame:
    """Outcome rows as one struct column ``result`` (code, message, existing_id, field)."""
    return outcomes.select("req_id", F.struct("code", "message", "existing_id", "field").alias("result"))
