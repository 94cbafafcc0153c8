"""Language ID by Bayesian evidence fusion.

Three kinds of evidence are multiplied: the likelihood of the text under byte
trigrams of each language, tempered since neighbouring trigrams are not
independent; the probability of the declared markup language given the language,
from a table of text verdicts against declarations; and a prior for the host
that is smoothed towards that of its address suffix, and this towards that of
the whole corpus.  The last two come from grouped aggregates of the text
verdicts over all rows; a page's own verdict is taken out of its host's counts.

A background hypothesis gives every trigram the same probability; where it wins
over all languages on a text of ENOUGH_TRIGRAMS trigrams or more, and where no
letter stands, the text is rejected.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hint_small, pieces, table
from .hashing import raw_text

BUCKETS = 1 << 14
#: Sampled documents of each language, and how many languages (each takes BUCKETS numbers in every worker).
TRAIN_ROWS = 500
MOST_LANGUAGES = 256
MOST_EVIDENCE = 40.0
HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT = 8.0, 4.0, 20.0
REJECT_BELOW = 0.5
BROADCAST_ROWS = 300_000

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
for _c in [*range(33), *range(33, 48), *range(48, 58), *range(58, 65), *range(91, 97), *range(123, 128)]:
    _FOLD[_c] = 32


ENOUGH_TRIGRAMS = 20


def has_letters(raw: bytes, bounds: np.ndarray) -> np.ndarray:
    """Whether each piece holds a byte that is not folded to a space."""
    letters = np.concatenate([[0], np.cumsum(_FOLD[np.frombuffer(raw, np.uint8)] != 32)])
    return letters[bounds[1:]] > letters[bounds[:-1]]


def trigrams(raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of each piece, ASCII non-letters folded to a space and runs of spaces left out; their numbers."""
    data = _FOLD[np.frombuffer(raw, np.uint8)]
    n = len(data)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(len(bounds) - 1, np.int64)
    owner_end = np.repeat(bounds[1:], np.diff(bounds))
    at = np.flatnonzero((np.arange(n - 2) + 3 <= owner_end[:-2]) & ~((data[:-2] == 32) & (data[1:-1] == 32)) & ~((data[1:-1] == 32) & (data[2:] == 32)))
    code = (data[at] * np.uint32(0x9E3779B1)) ^ (data[at + 1] * np.uint32(0x85EBCA77)) ^ (data[at + 2] * np.uint32(0xC2B2AE3D))
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    code ^= code >> np.uint32(13)
    return (code & np.uint32(BUCKETS - 1)).astype(np.int64), np.diff(np.searchsorted(at, bounds))


def sampled(docs: DataFrame, lang_col: str, rows: int) -> DataFrame:
    """(text, lang) of about `rows` labelled documents of each of the MOST_LANGUAGES most frequent languages, or all there are.

    A language's documents are taken by a threshold on a hash of the whole row
    that its number of rows sets, so no language is missed however rare it is,
    none is sorted, and rows that share an id are not taken together.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col("text").isNotNull()).select("text", F.col(lang_col).cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("mark"))
    many = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    # At most MOST_LANGUAGES rows.
    known = many.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    share = F.pmod(F.col("mark"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labelled.join(F.broadcast(known), "lang").where(share * F.col("n") < rows).select("text", "lang")


def train(docs: DataFrame, lang_col: str = "lang", rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities (languages x BUCKETS), from about `rows` labelled documents of each language.

    Counts are made on the executors; what comes to the driver is at most
    BUCKETS sums for each language.
    """

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                codes, counts = trigrams(*raw_text(piece.column(0)))
                langs = np.array(piece.column(1).to_pylist(), object)
                for name in set(langs):
                    sums = np.bincount(codes[np.repeat(langs == name, counts)], minlength=BUCKETS)
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sums.astype(np.int64)], pa.list_(pa.int64()))], names=["lang", "n"])

    counted = sampled(docs, lang_col, rows).mapInArrow(run, "lang string, n array<bigint>")
    each = counted.select("lang", F.posexplode("n").alias("bucket", "n")).where("n > 0").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("sums")).collect()
    table_ = {}
    for r in each:
        row = np.full(BUCKETS, 0.5)
        for b, n in r["sums"]:
            row[b] += n
        table_[r["lang"]] = np.log(row / row.sum())
    names = sorted(table_)
    return names, np.array([table_[n] for n in names]).reshape(-1, BUCKETS)


_OPEN = re.compile(r"<!--|<(script|style|nav|footer|noscript)\b", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "nav", "footer", "noscript")} | {"": re.compile("-->")}
_TAG = re.compile(r"<[^<>]*>")


def without_hidden(page: str) -> str:
    """The page with a space for each comment, script, style and navigation; one that is never closed stays.

    One scan forward: a kind of which no end was found is not sought again, so the time is linear in the page.
    """
    out, kept, at, endless = [], 0, 0, set()
    while (m := _OPEN.search(page, at)) is not None:
        kind = (m[1] or "").lower()
        end = None if kind in endless else _CLOSE[kind].search(page, m.end())
        if end is None:
            endless.add(kind)
            at = m.end()
        else:
            out += [page[kept : m.start()], " "]
            kept = at = end.end()
    return "".join([*out, page[kept:]])


def visible_text(page: str | None) -> str:
    """The text of a page without markup, scripts, styles, navigation and comments."""
    return html.unescape(_TAG.sub(" ", without_hidden(page or "")))


def text_verdict(names: list[str], logs: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tempered log likelihoods (rows x languages, the row's best 0), and whether the background wins."""
    ends = np.cumsum(counts)
    sums = np.stack([np.diff(np.concatenate([[0.0], np.cumsum(row[codes])])[np.concatenate([[0], ends])]) for row in logs], axis=1)
    noise = (sums < counts[:, None] * -np.log(BUCKETS)).all(axis=1) & (counts >= ENOUGH_TRIGRAMS)
    tempered = sums * (np.minimum(counts, MOST_EVIDENCE) / np.maximum(counts, 1))[:, None]
    return tempered - tempered.max(axis=1, keepdims=True), noise


def evidence(names: list[str], logs: np.ndarray, markup: bool):
    """A column function: (ll, noise) of a text, piece by piece so that memory is bounded by the longest text."""
    floor = -1e9

    @F.arrow_udf("struct<ll:array<double>,noise:boolean>")
    def told(column: pa.Array) -> pa.Array:
        made = []
        for piece in pieces(pa.RecordBatch.from_arrays([column], names=["text"]), "text"):
            texts = piece.column(0)
            if markup:
                texts = pa.array([visible_text(t) for t in texts.to_pylist()], pa.string())
            raw, bounds = raw_text(texts)
            codes, counts = trigrams(raw, bounds)
            ll, noise = text_verdict(names, logs, codes, counts)
            noise |= ~has_letters(raw, bounds)
            lists = pa.array(list(np.maximum(ll, floor)), pa.list_(pa.float64()))
            made.append(pa.StructArray.from_arrays([lists, pa.array(noise)], names=["ll", "noise"]))
        return pa.concat_arrays(made) if made else pa.array([], pa.struct([("ll", pa.list_(pa.float64())), ("noise", pa.bool_())]))

    return told


def _score(given: DataFrame, names: list[str], logs: np.ndarray, markup: bool) -> DataFrame:
    """given: (key, text, declared, host, suffix) -> the same without text, with ll and noise; key may be anything."""
    told = given.withColumn("told", evidence(names, logs, markup)("text"))
    return told.select("key", "declared", "host", "suffix", "told.ll", "told.noise")


def _norm(v: Column) -> Column:
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return F.transform(v, lambda x: x / total)


def fuse(scored: DataFrame, names: list[str]) -> DataFrame:
    """(key, lang, confidence, text_lang, accepted) from scored rows; every statistic is over all of them."""
    k = len(names)
    langs = F.lit(names)
    known = F.when(F.col("declared").isin(names), F.col("declared")).otherwise(F.when(F.col("declared").isNull(), F.lit("?")).otherwise(F.lit("*")))
    rows = scored.withColumn("declared", known).withColumn("p", F.when(F.col("noise"), F.array(*[F.lit(0.0)] * k)).otherwise(_norm(F.transform("ll", F.exp))))
    sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(k)]
    many = F.array(*[f"s{i}" for i in range(k)])
    # Prior of the corpus and the table of declarations: at most languages + 2 rows.
    told = {r["declared"]: [r[f"s{i}"] for i in range(k)] for r in rows.groupBy("declared").agg(*sums).collect()}
    corpus = np.array(list(told.values())).sum(axis=0) if told else np.zeros(k)
    prior = (corpus + 1.0) / (corpus.sum() + k)
    match = {}
    for d in [*names, "*", "?"]:
        expected = np.array([(0.8 if d == n else 0.2 / (k + 1)) for n in names]) if d != "?" else np.ones(k)
        match[d] = np.ones(k) if d == "?" else (np.array(told.get(d, np.zeros(k))) + DECLARED_WEIGHT * expected) / (corpus + DECLARED_WEIGHT)
    suffixes = cut(rows.where("suffix is not null").groupBy("suffix").agg(*sums).select("suffix", many.alias("sn")))
    hosts = cut(rows.where("host is not null").groupBy("host").agg(*sums).select("host", many.alias("hn")))
    near = rows.join(hint_small(suffixes, BROADCAST_ROWS), "suffix", "left").join(hint_small(hosts, BROADCAST_ROWS), "host", "left")
    zero = F.array(*[F.lit(0.0)] * k)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    lean = lambda v: F.transform(F.zip_with(F.coalesce(v, zero), "p", lambda x, y: x - y), lambda x: F.greatest(x, F.lit(0.0)))
    corpus_prior = F.array(*[F.lit(float(x)) for x in prior])
    out = near.withColumn("hn", F.when(F.col("host").isNull(), zero).otherwise(lean(F.col("hn")))).withColumn("sn", F.when(F.col("suffix").isNull(), zero).otherwise(lean(F.col("sn"))))
    out = out.withColumn("sp", F.zip_with("sn", corpus_prior, lambda s, c: (s + SUFFIX_WEIGHT * c) / (total(F.col("sn")) + SUFFIX_WEIGHT)))
    out = out.withColumn("hp", F.zip_with("hn", "sp", lambda h, s: (h + HOST_WEIGHT * s) / (total(F.col("hn")) + HOST_WEIGHT)))
    given = F.create_map(*[x for d, v in match.items() for x in (F.lit(d), F.array(*[F.lit(float(np.log(y))) for y in v]))])[F.col("declared")]
    text = F.when(F.col("noise"), zero).otherwise(F.col("ll"))
    joint = F.zip_with(F.zip_with(text, given, lambda a, b: a + b), "hp", lambda a, h: a + F.log(h))
    out = out.withColumn("joint", joint)
    out = out.withColumn("post", _norm(F.transform("joint", lambda x: F.exp(x - F.array_max("joint")))))
    best = F.array_max("post")
    pick = lambda v, m: F.element_at(langs, F.array_position(v, m).cast("int"))
    return out.select(
        "key",
        pick(F.col("post"), best).alias("lang"),
        F.round(best, 6).alias("confidence"),
        F.when(~F.col("noise"), pick(F.col("p"), F.array_max("p"))).alias("text_lang"),
        (~F.col("noise") & (best >= REJECT_BELOW)).alias("accepted"),
    )


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def suffix_of(host: Column) -> Column:
    return F.when(host.isNotNull(), F.substring_index(host, ".", -1))


def identify_pages(pages: DataFrame, labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(page_id, host, declared, lang, confidence, text_lang, accepted) for every page.

    A null page has no text; a page without a host or declaration leaves that
    evidence out.  Without labelled documents the result has null languages and
    accepts nothing.  Ties go to the first language in code point order.
    Repeated ids come back repeated, each row judged by its own page; other
    columns are not read; an empty table stays empty.  A worker holds some 35
    bytes for each byte of the longest page.
    """
    host = host_of(F.col("url"))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    said = F.when(declared != "", declared)
    key = F.struct(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), said.alias("declared"))
    given = pages.select(key.alias("key"), F.coalesce("html", F.lit("")).alias("text"), said.alias("declared"), host.alias("host"), suffix_of(host).alias("suffix"))
    names, logs = train(labelled, rows=train_rows)
    found = fuse(cut(_score(given, names, logs, True)), names) if names else _unknown(given)
    return found.select("key.*", "lang", "confidence", "text_lang", "accepted")


def _unknown(given: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return given.select("key", none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"), F.lit(False).alias("accepted"))


def _documents(docs: DataFrame, key: Column, train_rows: int) -> DataFrame:
    given = docs.select(key.alias("key"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("declared"), F.col("source").cast("string").alias("host"), F.lit(None).cast("string").alias("suffix"))
    names, logs = train(docs, rows=train_rows)
    return fuse(cut(_score(given, names, logs, False)), names) if names else _unknown(given)


def identify_documents(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, lang, confidence, text_lang, accepted): the lang column is the declaration, the source is the host.

    Null texts have no letters and are not accepted; null languages and sources
    leave that evidence out.  Without any labelled document nothing is accepted.
    Every row is judged by itself, repeated ids too; other columns are not read;
    an empty table stays empty.
    """
    return _documents(docs, F.col("doc_id").cast("long"), train_rows).withColumnRenamed("key", "doc_id")


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The documents whose language is accepted, with the columns of docs; lang becomes the verdict.

    A document with a letter is kept unless its text looks like no language at all;
    null, empty and wordless texts go.  Rows are carried beside their evidence, so
    no text is shuffled by id, repeated ids are judged row by row, and columns of
    any name stay.  Ties and empty tables: as identify_documents.
    """
    told = _documents(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), TRAIN_ROWS).where("accepted")
    return told.select(*[F.col("lang").alias(c) if c == "lang" else F.col("key")[c].alias(c) for c in docs.columns])


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    return identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
