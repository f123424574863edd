"""Personal data by weak supervision, in DataFrame operations only.

Candidates are the spans of four exact patterns (email, ip, card, phone) and long mixed tokens that may
be secrets. Labelers of three sorts vote on each candidate: patterns, gazetteers of prefixes and words,
and the context before the span. How often each pattern of votes and features occurs is counted over
the whole corpus; that table has at most one row for each combination, however large the corpus.
Expectation-maximisation on it estimates how reliable each labeler is and how likely each pattern is
personal data, and a logistic classifier of span features is fitted to these probabilities. It decides
on the tokens; spans of the exact patterns always stay.

Patterns run only on texts that hold the characters they need. Offsets are found without Python: the
text is split at the matches, and the lengths of pieces and matches add up. Possessive quantifiers
replace backtracking where the matches are the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedview.session import pin

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE = KINDS[:4]

_EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_DIGITS = r"[0-9]{13,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_TOKEN = r"(?<![A-Za-z0-9._%+@/-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{12,}+(?!\.?[A-Za-z0-9@%+/])"

#: Words before a value that say it is secret, and how secret keys of public services begin (fixed values).
_CUES = r"(?i)\b(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential)s?"
_PREFIXES = r"^(?:AKIA|ASIA|ghp_|gho_|github_pat_|sk-|sk_live_|xox[abp]-|AIza|glpat-)"

_SPANS = "array<struct<start:int,end:int,found:string,before:string>>"
_BEFORE = 32


def _none() -> Column:
    return F.array().cast(_SPANS)


def _matches(searched: Column, pattern: str, text: Column | None = None) -> Column:
    """Leftmost matches that do not overlap, with offsets in code points and the text just before each.

    ``searched`` has the length of ``text``, from which found strings are taken if it is given.
    """
    pieces = F.split(searched, pattern, -1)
    found = F.regexp_extract_all(searched, F.lit(pattern), F.lit(0))
    paired = F.filter(F.zip_with(pieces, found, lambda p, m: F.struct(p.alias("p"), m.alias("m"))), lambda x: x["m"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), _none().alias("out"))

    def add(done: Column, x: Column) -> Column:
        first = done["at"] + F.length(x["p"])
        end = first + F.length(x["m"])
        string = x["m"] if text is None else F.substring(text, first + 1, F.length(x["m"]))
        before = F.right(x["p"], F.lit(_BEFORE))
        span = F.struct(first.alias("start"), end.alias("end"), string.alias("found"), before.alias("before"))
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(span)).cast(_SPANS).alias("out"))

    return F.aggregate(paired, start, add, lambda done: done["out"])


def _luhn(digits: Column) -> Column:
    def add(total: Column, k: Column) -> Column:
        digit = F.substring(digits, -k, F.lit(1)).cast("int")
        doubled = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(k % 2 == 0, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the four exact patterns; a missing text has none.

    Cards are found in a copy of the text in which a blank or hyphen between two digits is a zero, so
    that a card is one run of digits there; the found string is taken from the text itself.
    """
    joined = F.regexp_replace(text, r"(?<=[0-9])[\x20-](?=[0-9])", "0")
    digits = lambda x: F.regexp_replace(x["found"], "[^0-9]", "")
    ip_ok = lambda x: x["found"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    card_ok = lambda x: F.length(digits(x)).between(13, 19) & _luhn(digits(x))
    phone_ok = lambda x: F.length(digits(x)).between(9, 15)
    return {
        "email": F.when(F.contains(text, F.lit("@")), _matches(text, _EMAIL)).otherwise(_none()),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(_matches(text, _IP), ip_ok)).otherwise(_none()),
        "card": F.when(text.rlike(r"[0-9][0-9\x20-]{11,}[0-9]"), F.filter(_matches(joined, _DIGITS, text), card_ok)).otherwise(_none()),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(_matches(text, _PHONE), phone_ok)).otherwise(_none()),
    }


def _share(x: Column, drop: str) -> Column:
    return 1 - F.length(F.regexp_replace(x, drop, "")) / F.length(x)


def _votes(kind: Column, found: Column, before: Column) -> dict[str, Column]:
    """1 for personal data, 0 against, null for no opinion."""
    token = kind == "secret"
    assigned = before.rlike(rf"{_CUES}\x20*[:=]\x20*[\"']?$")
    digits = _share(found, "[0-9]")
    vote = lambda yes, no: F.when(yes, 1).when(no, 0)
    never = F.lit(False)
    return {
        "pattern_exact": vote(~token, never),
        "pattern_hex": vote(token & found.rlike(r"^[0-9a-f]{16,}$"), token & found.rlike(r"[g-zG-Z]{5}")),
        "pattern_key": vote(token & found.rlike(r"^[A-Z0-9]{16,}$"), token & found.rlike(r"[_-]") & ~assigned),
        "gazetteer_prefix": vote(token & found.rlike(_PREFIXES), never),
        "gazetteer_words": vote(never, token & found.rlike(r"(?i)page|chapter|version|figure|section|item|^utf|^iso")),
        "context_cue": vote(assigned, token & (F.length(before) >= 8) & ~before.rlike(_CUES) & before.rlike(r"[a-z]\x20$")),
        "context_mix": vote(token & (digits >= 0.25), token & (digits < 0.12)),
    }


def _features(kind: Column, found: Column, before: Column) -> dict[str, Column]:
    """0/1 features of a span."""
    digits = _share(found, "[0-9]")
    of = lambda x: x.cast("int")
    return {
        "exact": of(kind != "secret"),
        "long": of(F.length(found) >= 20),
        "digits": of(digits >= 0.2),
        "many_digits": of(digits >= 0.4),
        "hex": of(found.rlike(r"^[0-9a-f]+$")),
        "capitals": of(found.rlike(r"^[A-Z0-9]+$")),
        "prefix": of(found.rlike(_PREFIXES)),
        "separators": of(found.rlike(r"[_-]")),
        "assigned": of(before.rlike(r"[:=]\x20*[\"']?$")),
        "cue": of(before.rlike(_CUES)),
    }


@dataclass(frozen=True)
class SpanModel:
    """Reliabilities of the labelers, and the weights of the span classifier (bias first)."""

    reliability: dict[str, tuple[float, float]]
    weights: dict[str, float]

    def score(self, kind: Column, found: Column, before: Column) -> Column:
        logit = F.lit(self.weights["bias"])
        for name, value in _features(kind, found, before).items():
            logit = logit + self.weights[name] * value
        return 1 / (1 + F.exp(-logit))


def aggregate_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of each vote pattern, and the labelers' chances to vote 1 on true and on false spans.

    ``votes`` has a row per pattern (1, 0, or -1 for none), ``counts`` how often it occurs. Starts from
    the majority. Labelers are held to be right more often than not: chances stay within 0.7 to 0.95 on
    true spans and 0.05 to 0.3 on false ones, so that two groups of true spans with different votes are
    not taken for a true and a false one.
    """
    cast, yes = votes >= 0, votes == 1
    lead = yes.sum(1) - (cast & ~yes).sum(1)
    p = 1 / (1 + np.exp(-1.5 * lead))
    for _ in range(rounds):
        rate = []
        for weight in (p * counts, (1 - p) * counts):
            rate.append(((weight[:, None] * yes).sum(0) + 1) / ((weight[:, None] * cast).sum(0) + 2))
        true, false = np.clip(rate[0], 0.7, 0.95), np.clip(rate[1], 0.05, 0.3)
        prior = np.clip((p * counts).sum() / counts.sum(), 0.01, 0.99)
        log = np.log(prior / (1 - prior)) + (cast * np.where(yes, np.log(true / false), np.log((1 - true) / (1 - false)))).sum(1)
        p = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return p, true, false


def fit_logistic(x: np.ndarray, target: np.ndarray, counts: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights (bias first) for soft targets with counts, by damped Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    scale = counts / counts.sum() * min(counts.sum(), 1000)
    penalty = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(scale @ (np.logaddexp(0, z) - target * z) + w @ penalty @ w / 2)

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        curve = (x * (scale * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(curve, x.T @ (scale * (target - p)) - penalty @ w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def candidates(docs: DataFrame, texts: bool = False) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``, the text only if ``texts``) and the array ``spans`` of
    (kind, start, end, found, before) of each row, written once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if texts or c != "text")).alias("row")
    tokens = F.when(text.rlike("[0-9]"), _matches(text, _TOKEN)).otherwise(_none())
    found = pin(docs.select(row, *(c.alias(kind) for kind, c in {**base_spans(text), "secret": tokens}.items())), "pii-spans")

    def tagged(kind: str) -> Column:
        fields = ("start", "end", "found", "before")
        return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), *(x[f].alias(f) for f in fields)))

    apart = lambda x: ~F.exists("exact", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    found = found.withColumn("exact", F.concat(*(tagged(kind) for kind in BASE)))
    return found.select("row", F.concat("exact", F.filter(tagged("secret"), apart)).alias("spans"))


def fit_spans(found: DataFrame) -> SpanModel:
    """Count votes and features over all candidates, weigh the labelers, fit the classifier."""
    each = found.select(F.explode("spans").alias("s"))
    kind, string, before = F.col("s.kind"), F.col("s.found"), F.col("s.before")
    votes, features = _votes(kind, string, before), _features(kind, string, before)
    columns = [F.coalesce(v, F.lit(-1)).alias(f"v_{n}") for n, v in votes.items()]
    columns += [f.alias(f"f_{n}") for n, f in features.items()]
    rows = each.select(*columns).groupBy(*(f"v_{n}" for n in votes), *(f"f_{n}" for n in features)).count().collect()
    if not rows:
        return SpanModel({}, dict.fromkeys(["bias", *features], 0.0))
    table = np.array([list(row) for row in rows], float)
    counts = table[:, -1]
    p, true, false = aggregate_votes(table[:, : len(votes)], counts)
    weights = fit_logistic(table[:, len(votes) : -1], p, counts)
    reliability = {name: (float(a), float(b)) for name, a, b in zip(votes, true, false, strict=True)}
    return SpanModel(reliability, dict(zip(["bias", *features], map(float, weights), strict=True)))


def find_personal_data(docs: DataFrame, least: float = 0.5, texts: bool = False) -> DataFrame:
    """``row`` and the array ``spans`` of (kind, start, end), in order of kind and start.

    ``row`` is a struct of the columns of ``docs``, the text only if ``texts``, so their names may be any.
    Every row of ``docs`` gives one row. A missing or empty text has no spans. Offsets are code points,
    the end is exclusive.
    """
    found = candidates(docs, texts)
    model = fit_spans(found)
    keep = F.filter("spans", lambda x: (x["kind"] != "secret") | (model.score(x["kind"], x["found"], x["before"]) >= least))
    spans = F.transform(keep, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return found.select("row", spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans are replaced together."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(done: Column, x: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, x["start"] - done["at"])
        new = F.concat(done["out"], gap, F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        apart = x["start"] >= done["at"]
        return F.struct(F.greatest(done["at"], x["end"]).alias("at"), F.when(apart, new).otherwise(done["out"]).alias("out"))

    rest = lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(ordered, empty, add, rest)).otherwise(text)
