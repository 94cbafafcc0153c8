"""Secret scans with corpus-wide ownership frequency, in built-in functions only.

A scan finds candidate spans of each kind.  Hashes of the candidates' values are
aggregated by owner and then over owners: a value that many owners carry, in as
many repositories, is a copied example; one that stays with few owners, or in
few repositories (the forks of one), looks live.  Rows are
pre-aggregated by (value, owner), so a value that a third of all documents hold
is as many rows as it has owners.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hint_small, table, unused
from .spans import joined, match_spans

#: Fixed values of the base kinds: (kind, pattern, group that holds the value, least length of the value, words of which the lower-cased text must hold one).
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ["password", "passwd", "secret", "token", "apikey", "api_key"]),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, ["akia"]),
    ("hex", r"[0-9a-f]{32,}", 0, 32, []),
]
_KEY = r"(?: [A-Z0-9]{1,20}){0,4} PRIVATE KEY-----"
_BREAK = r"(?:\s|\\[nr])"
#: What stands before the END line; without one, the lines of base64 that follow (possessive, so that no match recurses).
_BODY = (
    rf"(?:[^-]*+-(?!----))*+[^-]*+(?=-----END{_KEY})"
    rf"|(?:\s*+(?:Proc-Type|DEK-Info):[^\r\n]*+)*+(?:{_BREAK}++[A-Za-z0-9+/=]{{16,}}+)++(?:(?:\r?\n|\\n)[A-Za-z0-9+/]{{1,15}}+={{0,2}}+(?=[ \t]*+(?:[\r\n]|\\n|\z)))?+"
    r"|"
)
MORE = [
    ("key", rf"-----BEGIN{_KEY}({_BODY})(?:-----END{_KEY})?+", 1, 0, ["-----begin"]),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, ["eyj"]),
    ("forge", r"(?:gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,})", 0, 1, ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-"]),
    ("chat", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", 0, 1, ["xox"]),
    ("cloud", r"AIza[A-Za-z0-9_-]{35}", 0, 1, ["aiza"]),
    ("pay", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", 0, 1, ["k_live_", "k_test_"]),
    ("bearer", r"(?i)bearer\x20+([A-Za-z0-9+/_.=~-]{16,})", 1, 16, ["bearer"]),
    ("url", r"(?:https?|ftp|ssh|git|redis|amqp|mysql|mongodb|postgres(?:ql)?)://[^\s/:@]{1,64}:([^\s/:@]{1,128})@", 1, 1, ["://"]),
]
KINDS = BASE + MORE
EXAMPLE_OWNERS = 3
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|change_me|placeholder|your[_-]|xxxx|0000000|1234567|abcdef"
#: In longer key bodies a placeholder's letters stand by chance.
DUMMY_KEY_CHARS = 200
BROADCAST_ROWS = 500_000
MASK = "[SECRET]"
SPANS = "array<struct<start:int,rank:int,kind:string,stop:int,hash:bigint,dummy:boolean>>"


def find_spans(text: Column, low: Column) -> Column:
    """All candidate spans of a text, by start and then kind as listed."""

    def one(rank: int, kind: str, pattern: str, group: int, least: int, words: list[str]) -> Column:
        found = F.filter(match_spans(text, F.lit(pattern), group), lambda s: F.length(s["value"]) >= least)
        # One key is one value however its lines are broken.
        value = lambda s: F.regexp_replace(s["value"], _BREAK, "") if kind == "key" else s["value"]
        dummy = lambda s: s["value"].rlike(PLACEHOLDER) & (F.lit(kind != "key") | (F.length(value(s)) < DUMMY_KEY_CHARS))
        made = F.transform(
            found,
            lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["stop"].alias("stop"), F.xxhash64(value(s)).alias("hash"), dummy(s).alias("dummy")),
        )
        gate = reduce(lambda a, b: a | b, [low.contains(w) for w in words]) if words else text.rlike(pattern)
        return F.when(gate, made).otherwise(F.array().cast(SPANS))

    return F.array_sort(F.concat(*[one(i, *k) for i, k in enumerate(KINDS)]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """(doc_id, check, owner, repo, spans) for each row: one pass over the texts."""
    repo = F.col(repo_col) if repo_col else F.col(id_col)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(owner_col).cast("string").alias("owner"), repo.cast("string").alias("repo"))
    read = given.withColumn("low", F.lower("text"))
    return read.select("doc_id", F.xxhash64("text").alias("check"), "owner", "repo", find_spans(F.col("text"), F.col("low")).alias("spans"))


def ownership(scanned: DataFrame) -> DataFrame:
    """(hash, owners, repos): in how many distinct owners and repositories each candidate value occurs; repeated rows count once."""
    seen = scanned.select("owner", "repo", F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash")).distinct()
    owners = seen.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("owners"))
    # A repository under several owners is one.
    repos = seen.groupBy("hash", "repo").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("repos"))
    return owners.join(repos, "hash")


def judged(scanned: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(doc_id, check, marks) for each distinct text with spans: live is false for copied examples and placeholders.

    owners and repos are those of a copied value, 0 of any other; scanned has been cut.
    """
    wide = cut(ownership(scanned).where((F.col("owners") >= example_owners) & (F.col("repos") >= example_owners)))
    rows = scanned.where(F.size("spans") > 0).select("doc_id", "check", "spans").dropDuplicates(["doc_id", "check"])
    each = rows.select("doc_id", "check", F.explode("spans").alias("s")).withColumn("hash", F.col("s")["hash"])
    told = each.join(hint_small(wide, BROADCAST_ROWS), "hash", "left").withColumn("live", F.col("owners").isNull() & ~F.col("s")["dummy"])
    one = F.struct(*[F.col("s")[c].alias(c) for c in ("start", "rank", "kind", "stop")], "live", F.coalesce("owners", F.lit(0)).cast("long").alias("owners"), F.coalesce("repos", F.lit(0)).cast("long").alias("repos"))
    return told.groupBy("doc_id", "check").agg(F.array_sort(F.collect_list(one)).alias("marks"))


MARKS = "array<struct<start:int,rank:int,kind:string,stop:int,live:boolean,owners:bigint,repos:bigint>>"


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans, and how many look live or copied.

    copied_owners and copied_repos are the most owners and repositories of a
    copied value of the document, 0 without one.  Null texts are empty.  A null
    owner counts as one owner; without repo_col every id is its own repository.
    Repeated rows come back repeated and count once in both numbers.  Other
    columns are not read; an empty table stays empty.  The time is linear in a
    text and its matches.
    """
    scanned = cut(scan(docs, id_col, text_col, owner_col, repo_col))
    marks = judged(scanned).withColumnsRenamed({"doc_id": "_id", "check": "_check"})
    same = [F.col("doc_id").eqNullSafe(F.col("_id")), F.col("check") == F.col("_check")]
    marked = scanned.join(marks, same, "left").select("doc_id", F.coalesce("marks", F.array().cast(MARKS)).alias("spans"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long")
    most = lambda c: F.coalesce(F.array_max(F.transform("spans", lambda s: s[c])), F.lit(0)).cast("long")
    return marked.select(
        "doc_id",
        *[count(i).alias(f"n_{k[0]}") for i, k in enumerate(BASE)],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        live.alias("n_live"),
        (F.size("spans") - live).cast("long").alias("n_copied"),
        most("owners").alias("copied_owners"),
        most("repos").alias("copied_repos"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """The documents with every live-looking span masked in the text; copied examples stay.

    Columns and rows stay as they are, but n_chars, where there is one, follows
    the text.  Null and empty texts have no spans; repeated rows come back
    repeated; an empty table stays empty.  Only texts with spans are joined with
    their marks; the others pass.
    """
    id_, check, spans, marks, row = unused(docs, "_id", "_check", "_spans", "_marks", "_row")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col(id_col).cast("long").alias(id_), text.alias("text"), F.col(owner_col).cast("string").alias("owner"), F.col(id_col).cast("string").alias("repo"))
    # The lower case has a column of its own, so that it is made once for all kinds.
    found = find_spans(F.col("text"), F.col("low")).alias(spans)
    read = cut(given.withColumn("low", F.lower("text")).select(row, id_, F.xxhash64("text").alias(check), "owner", "repo", found))
    scanned = read.select(F.col(id_).alias("doc_id"), F.col(check).alias("check"), "owner", "repo", F.col(spans).alias("spans"))
    live = judged(scanned).select(F.col("doc_id").alias(f"{id_}2"), F.col("check").alias(f"{check}2"), F.filter("marks", lambda s: s["live"]).alias(marks))
    live = cut(live.where(F.size(marks) > 0))
    same = [F.col(id_).eqNullSafe(F.col(f"{id_}2")), F.col(check) == F.col(f"{check}2")]
    bare = read.where(F.size(spans) == 0).select(f"{row}.*")
    rich = read.where(F.size(spans) > 0).select(row, id_, check).join(hint_small(live, BROADCAST_ROWS // 5), same, "left").select(f"{row}.*", marks)
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        mask = F.when(s["start"] >= acc["at"], F.lit(MASK)).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], between, mask).alias("out"))

    masked = F.aggregate(marks, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    both = rich.withColumn(text_col, F.when(F.col(marks).isNotNull(), masked).otherwise(text))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(F.col(marks).isNotNull(), F.length(text_col).cast("long")).otherwise(F.col("n_chars")))
    return bare.unionByName(both.select(*docs.columns))


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))
