"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give the base spans.  The field labels the tokens that could be
personal data (those with a digit or an @): each is a node; nodes that stand
close are linked in a chain.  Skip links join all nodes of one normal form,
however far apart, through a node for the form, and forms that differ in one
character with each other.  Loopy belief propagation lets a number that is
clearly a phone number once carry its label to places where its form alone
would not do.

Weights of features, chain and skip links are fitted together by
pseudo-likelihood on a bounded sample.  Its labels come from the patterns; half
of what they found is then written in ways that they don't take (a card with a
wrong digit, a number without its plus sign, an address spelt out), so that the
field learns the kinds and not the patterns.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, pieces, table

BASE_KINDS = ["email", "ip", "card", "phone"]
LABELS = ["other", *BASE_KINDS]
TRAIN_ROWS = 3_000
TRAIN_NODES = 300
NEAR_TOKENS = 4
ROUNDS, SETTLED = 200, 1e-3
SURE = 0.7
RIDGE = 2e-5
LEAST_FORM, MOST_FORM = 6, 40
MORE_KINDS = [f"crf-{k}" for k in BASE_KINDS]
KINDS = BASE_KINDS + MORE_KINDS

#: Fixed values of the base patterns. Digit runs are possessive: giving digits back cannot help an address that starts at a run.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_DIGITS = re.compile(r"[0-9]")
_LONG = re.compile(r"[0-9](?:[\x20-]?[0-9]){11}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the local part is the run before an @, no farther back than the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = end = m.end()
        at = text.find("@", end)
    return out


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, by start and then kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DOTTED.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    if _LONG.search(text):
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


_TOKEN = re.compile(r"\S+")
#: What a token must hold to be a node: a digit, an @, or a word in its place.
_CANDIDATE = re.compile(r"[0-9@]|[(\[]at[)\]]")
#: Words that announce personal data.
_CUES = {w: i for i, w in enumerate(["phone", "tel", "call", "fax", "mobile", "mail", "email", "contact", "write", "card", "visa", "account", "ip", "host", "server", "address", "reach", "at"])}
_TRIM = "\"'()[]{}<>,;:!?*#%$&|"
_BUCKETS = [1, 2, 3, 4, 7, 9, 10, 12, 16, 17, 20, 32]
_MARKS = ["@", "+", "(", ")", "/", ":", "_", "at)", "at]", ",", "%", "="]
_SIZES = 1 + len(_BUCKETS)
_PARTS = [1, _SIZES, _SIZES, 6, 5, 5, len(_MARKS), 4, len(_CUES)]
_AT = [sum(_PARTS[:k]) for k in range(len(_PARTS))]
N_FEATURES = sum(_PARTS)


def _bucket(n: int) -> int:
    return sum(n >= b for b in _BUCKETS)


def features(token: str, before: str, after: str) -> list[int]:
    """Numbers of the binary features that hold for a token between two others; below N_FEATURES."""
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    out = [0, _AT[1] + _bucket(digits), _AT[2] + _bucket(letters)]
    out += [_AT[3] + min(token.count("."), 5), _AT[4] + min(token.count("-"), 4), _AT[5] + min(max((len(p) for p in _DIGIT_RUN.findall(token)), default=0), 4)]
    out += [_AT[6] + k for k, c in enumerate(_MARKS) if c in token]
    out += [_AT[7] + k for k, near in enumerate((before, after)) if _CANDIDATE.search(near)]
    if digits and digits + sum(token.count(c) for c in ".-, ") == len(token):
        out.append(_AT[7] + 2)
    if letters and digits and all(c in "0123456789abcdefABCDEF" for c in token):
        out.append(_AT[7] + 3)
    cue = _CUES.get(before.strip(_TRIM).lower())
    return out if cue is None else [*out, _AT[8] + cue]


_DIGIT_RUN = re.compile(r"[0-9]+")


def normal_form(token: str) -> str:
    digits = _digits(token)
    return digits if len(digits) >= 6 and "@" not in token else token.lower().rstrip(".")


def nodes_of(text: str) -> list[tuple[int, int, int, str, list[int]]]:
    """(start, end, number among all tokens, normal form, features) of the candidate tokens."""
    out, before, held = [], "", None

    def close(after: str) -> None:
        if held is not None:
            start, kept, n, left = held
            out.append((start, start + len(kept), n, normal_form(kept), features(kept, left, after)))

    for n, m in enumerate(_TOKEN.finditer(text)):
        token = m[0]
        close(token)
        held = None
        if _CANDIDATE.search(token):
            kept = token.strip(_TRIM).rstrip(".")
            # Brackets around a number, as in (030), belong to it.
            kept = f"({kept})" if f"({kept})" in token else kept
            if kept:
                held = (m.start() + token.index(kept), kept, n, before)
        before = token
    close("")
    return out


def chain_of(nodes: list) -> np.ndarray:
    """Links of neighbours within NEAR_TOKENS."""
    return np.array([(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1][2] - nodes[i][2] <= NEAR_TOKENS], np.int64).reshape(-1, 2)


def similar_forms(forms: list[str]) -> list[tuple[int, int]]:
    """Pairs of forms that are equal once one character is left out of either or both; those of one rest form a path.

    Forms under LEAST_FORM characters are too short to say anything, and over MOST_FORM only equal ones are linked.
    """
    last: dict[str, int] = {}
    pairs = set()
    for k, form in enumerate(forms):
        if LEAST_FORM <= len(form) <= MOST_FORM:
            for rest in {form, *(form[:i] + form[i + 1 :] for i in range(len(form)))}:
                other = last.get(rest)
                if other is not None and other != k:
                    pairs.add((other, k))
                last[rest] = k
    return sorted(pairs)


def hubs_of(nodes: list) -> tuple[np.ndarray, np.ndarray]:
    """Skip links: (node, hub) for forms that occur more than once or are like another one, and (hub, hub) of like forms.

    All nodes of one form meet in one hub, so a label reaches each of them in two steps, and links are as many as nodes.
    """
    number: dict[str, int] = {}
    home = [number.setdefault(n[3], len(number)) for n in nodes]
    alike = similar_forms(list(number))
    many = np.bincount(home, minlength=len(number)) if home else np.zeros(0, np.int64)
    used = sorted({k for k, c in enumerate(many.tolist()) if c > 1} | {k for pair in alike for k in pair})
    place = {k: at for at, k in enumerate(used)}
    members = [(i, place[h]) for i, h in enumerate(home) if h in place]
    return np.array(members, np.int64).reshape(-1, 2), np.array([(place[a], place[b]) for a, b in alike], np.int64).reshape(-1, 2)


def covered(nodes: list, spans: list) -> np.ndarray:
    """The label of each node by the first base span that overlaps it, 0 without one; both come in order."""
    out = np.zeros(len(nodes), np.int64)
    kinds = [([a for a, k, _ in spans if k == kind], [b for _, k, b in spans if k == kind]) for kind in range(len(BASE_KINDS))]
    for i, n in enumerate(nodes):
        # Spans of one kind don't overlap: the first that ends after the node's start is the only candidate.
        met = []
        for kind, (starts, ends) in enumerate(kinds):
            at = bisect_right(ends, n[0])
            if at < len(starts) and starts[at] < n[1]:
                met.append((starts[at], kind))
        if met:
            out[i] = min(met)[1] + 1
    return out


class Field:
    """Weights of the conditional random field: of features, chain links, links of a node with its form, links of like forms."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, same: np.ndarray, like: np.ndarray):
        self.weights, self.chain, self.same, self.like = weights, chain, same, like

    def unary(self, nodes: list) -> np.ndarray:
        return np.array([self.weights[n[4]].sum(axis=0) for n in nodes])

    def marginals(self, nodes: list, fixed: np.ndarray | None = None) -> np.ndarray:
        """Loopy belief propagation, all messages at once, until they settle or ROUNDS times; fixed: labels known for sure (0: not)."""
        unary = self.unary(nodes)
        if fixed is not None and fixed.any():
            unary[fixed > 0] = -30.0
            unary[np.flatnonzero(fixed), fixed[fixed > 0]] = 0.0
        n, k = unary.shape
        chain, (members, alike) = chain_of(nodes), hubs_of(nodes)
        hubs = int(members[:, 1].max()) + 1 if len(members) else 0
        unary = np.concatenate([unary, np.zeros((hubs, k))])
        links = np.concatenate([chain, members + [0, n], alike + n])
        belief = unary
        if len(links):
            forward = np.concatenate([np.repeat(p[None], c, 0) for p, c in ((self.chain, len(chain)), (self.same, len(members)), (self.like, len(alike)))])
            src, dst = np.concatenate([links, links[:, ::-1]]).T
            potential = np.concatenate([forward, forward.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
            messages = np.zeros((len(src), k))
            for _ in range(ROUNDS):
                belief = unary.copy()
                np.add.at(belief, dst, messages)
                out = np.logaddexp.reduce((belief[src] - messages[back])[:, :, None] + potential, axis=1)
                out -= np.logaddexp.reduce(out, axis=1, keepdims=True)
                moved = np.abs(out - messages).max()
                messages = 0.5 * messages + 0.5 * out
                if moved < SETTLED:
                    break
            belief = unary.copy()
            np.add.at(belief, dst, messages)
        belief = belief[:n]
        return np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True))


def fit(samples: list[tuple[list, np.ndarray]], rounds: int = 3_000) -> Field:
    """All weights together by pseudo-likelihood: each node's label given its features and its neighbours' labels.

    A node sees the labels of its chain neighbours, the commonest label of the
    other nodes of its form, and that of each like form.  Equal rows are one row
    with its counts of labels, so the fit costs little however many nodes there are.
    """
    k = len(LABELS)
    counts: dict[tuple, np.ndarray] = {}
    for nodes, label in samples:
        if not len(nodes):
            continue
        seen: list[list[int]] = [list(n[4]) for n in nodes]
        for a, b in chain_of(nodes).tolist():
            seen[b].append(N_FEATURES + int(label[a]))
            seen[a].append(N_FEATURES + k + int(label[b]))
        members, alike = hubs_of(nodes)
        votes = np.zeros((int(members[:, 1].max()) + 1 if len(members) else 0, k), np.int64)
        np.add.at(votes, (members[:, 1], label[members[:, 0]]), 1)
        own = dict(members.tolist())
        for i, h in own.items():
            others = votes[h].copy()
            others[label[i]] -= 1
            if others.any():
                seen[i].append(N_FEATURES + 2 * k + int(others.argmax()))
        by: dict[int, list[int]] = {}
        for a, b in alike.tolist():
            by.setdefault(a, []).append(b)
            by.setdefault(b, []).append(a)
        for i, h in own.items():
            seen[i] += [N_FEATURES + 3 * k + int(votes[o].argmax()) for o in by.get(h, ())]
        for row, y in zip(seen, label.tolist(), strict=True):
            counts.setdefault(tuple(row), np.zeros(k))[y] += 1
    weights = np.zeros((N_FEATURES + 4 * k, k))
    if counts:
        x = np.zeros((len(counts), len(weights)))
        for r, row in enumerate(counts):
            np.add.at(x[r], list(row), 1)
        y = np.array(list(counts.values()))
        total = y.sum()
        step = 4.0 / max(1.0, (x**2).sum(axis=1).max())
        speed = np.zeros_like(weights)
        for _ in range(rounds):
            scores = x @ weights
            p = np.exp(scores - np.logaddexp.reduce(scores, axis=1, keepdims=True)) * y.sum(axis=1, keepdims=True)
            speed = 0.9 * speed - step * (x.T @ (p - y) / total + RIDGE * weights)
            weights += speed
    left, right, same, like = (weights[N_FEATURES + a * k : N_FEATURES + (a + 1) * k] for a in range(4))
    return Field(weights[:N_FEATURES], (left + right.T) / 2, (same + same.T) / 2, (like + like.T) / 2)


def masked(text: str, spans: list, seed: int) -> tuple[str, list]:
    """The text with about half of its base spans written so that no pattern finds them, and where all of them stand now.

    Some masked ones are named once more at the end, as texts do.  This is what the field learns from: the patterns know
    the labels, and the changed form is all that it sees.
    """
    rng = random.Random(seed)
    out, kept, at, again = [], [], 0, []
    size = 0

    def put(piece: str, kind: int | None = None) -> None:
        nonlocal size
        if kind is not None:
            kept.append((size, kind, size + len(piece)))
        out.append(piece)
        size += len(piece)

    for a, kind, b in spans:
        if a < at:
            continue
        put(text[at:a])
        entity = text[a:b]
        if rng.random() < 0.5:
            if rng.random() < 0.4:
                again.append((kind, entity))
            entity = disguised(entity, kind, rng)
        put(entity, kind)
        at = b
    put(text[at:])
    for kind, entity in again:
        put(" ")
        put(disguised(entity, kind, rng), kind)
    return "".join(out), kept


def disguised(entity: str, kind: int, rng: random.Random) -> str:
    """An entity of a base kind in a form that its pattern does not take."""
    if kind == 0:
        return entity.replace("@", rng.choice(["(at)", "[at]", "@@"]))
    if kind == 1:
        parts = entity.split(".")
        return rng.choice([",".join(parts), ".".join([*parts[:3], "x"]), ".".join([str(300 + int(parts[0][-2:])), *parts[1:]])])
    if kind == 2:
        digits = _digits(entity)
        wrong = digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10)
        return rng.choice([wrong, wrong, ".".join(digits[k : k + 4] for k in range(0, len(digits), 4))])
    bare = entity.lstrip("+")
    return rng.choice([bare, bare, bare.split(" ", 1)[-1], "00" + bare])


def all_spans(text: str, field: Field) -> tuple[list, list]:
    """The base spans, and these with the field's own, both by start and then kind.

    Neighbouring nodes of one label are one span, as far as it meets no base span.
    """
    base = base_spans(text)
    if not _CANDIDATE.search(text):
        return base, base
    nodes = nodes_of(text)
    known = covered(nodes, base)
    if not len(nodes) or known.all():
        return base, base
    p = field.marginals(nodes, fixed=known)
    best = np.where((known == 0) & (p.max(axis=1) >= SURE), p.argmax(axis=1), 0)
    more: list[tuple[int, int, int]] = []
    last = -2
    for i in np.flatnonzero(best).tolist():
        start, end, number = nodes[i][:3]
        kind = len(BASE_KINDS) + int(best[i]) - 1
        if last == i - 1 and more[-1][1] == kind and nodes[last][2] == number - 1:
            more[-1] = (more[-1][0], kind, end)
        else:
            more.append((start, kind, end))
        last = i
    return base, sorted(base + more)


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Field:
    """Fit on about `rows` documents with candidates, twice each: as they are and masked; docs: (doc_id, text).

    A threshold on a hash of the whole row that the number of such documents
    sets draws them, so nothing is sorted and rows that share an id are not
    taken together; twice as many is the bound.  Features of at most TRAIN_NODES
    tokens of each come to the driver, with their normal forms, and no texts.
    """
    met = docs.where(F.col("text").rlike(_CANDIDATE.pattern))
    n = met.count()
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = met.where(share * F.lit(n) < rows).limit(2 * rows)

    def seen(text: str, spans: list) -> tuple[list, list]:
        nodes = nodes_of(text)[:TRAIN_NODES]
        return [[x[2], y, *x[4]] for x, y in zip(nodes, covered(nodes, spans).tolist(), strict=True)], [x[3] for x in nodes]

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                rows_, forms = [], []
                for text in piece.column(0).to_pylist():
                    spans = base_spans(text)
                    seed = int.from_bytes(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:6], "big")
                    for one in ((text, spans), masked(text, spans, seed)) if spans else ((text, spans),):
                        made, names = seen(*one)
                        rows_.append([list(map(int, r)) for r in made])
                        forms.append(names)
                yield pa.RecordBatch.from_arrays([pa.array(rows_, pa.list_(pa.list_(pa.int64()))), pa.array(forms, pa.list_(pa.string()))], names=["nodes", "forms"])

    got = sample.select("text").mapInArrow(run, "nodes array<array<bigint>>, forms array<string>").collect()
    return fit([([(0, 0, x[0], form, x[2:]) for x, form in zip(r["nodes"], r["forms"], strict=True)], np.array([x[1] for x in r["nodes"]], np.int64)) for r in got if r["nodes"]])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans.

    Null texts are empty and have no spans.  Repeated rows come back repeated;
    null ids stay null.  Other columns are not read; an empty table stays empty.
    Positions count code points.  Ties of labels go to the first of LABELS.  Time
    and memory are linear in a text's tokens.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bound_batches(docs.sparkSession)
    field = train(given, train_rows)
    parts = (field.weights, field.chain, field.same, field.like)

    def run(batches):
        own = Field(*parts)
        for batch in batches:
            for piece in pieces(batch, "text"):
                counts, digests, spans = [], [], []
                for text in piece.column(1).to_pylist():
                    base, every = all_spans(text, own)
                    counts.append([sum(k == i for _, k, _ in base) for i in range(len(BASE_KINDS))])
                    digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    spans.append(_joined(every))
                columns = np.array(counts, np.int64).reshape(-1, len(BASE_KINDS)).T
                yield pa.RecordBatch.from_arrays([piece.column(0), *map(pa.array, columns), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return given.mapInArrow(run, SCHEMA)


def op10_personal_data(spark, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
