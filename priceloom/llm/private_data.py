"""Personal data by weak supervision, in SQL expressions only.

Patterns propose spans. Labelers (a pattern check, a gazetteer, the words before the span, its shape,
its surroundings) vote yes, no or nothing on each. Expectation-maximisation over the counts of vote
patterns in the whole corpus estimates how reliable each labeler is and how likely each pattern is
personal data; a logistic classifier over the kind and features of a span is trained on those
probabilities, and decides about the proposals that no rule settles. Spans of the base kinds are
settled by their rule and always stay.

Only counts per vote pattern reach the driver: at most kinds x 3^labelers x 2^features rows.
"""

import math
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Patterns. The base ones are written so that Java's matcher needs no backtracking and no recursion on
# long runs; they find what the plain forms in the comments find.
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    # [0-9]([\x20-]?[0-9])+
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9](?:[\x20-]?[0-9]){15}"),
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
MORE = {
    "local_phone": (r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
                    r"[0-9][\x20.-][0-9]{3}[\x20.-][0-9]{4}"),
    # Whole runs of any length that hold a digit; a match begins only where a run does.
    "secret": (r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+",
               r"[A-Za-z0-9_-]{20}"),
}
KINDS = [*BASE, *MORE]

# What the labelers know.
DOMAINS = ["com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info"]
ISSUERS = ["34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "60", "62", "65"]
COUNTRY_CODES = ["+1", "+33", "+34", "+44", "+49", "+39", "+81", "+86", "+91"]
CUES = {
    "email": "mail|contact|write|address", "ip": "ip|host|server|address", "card": "card|visa|account|pay",
    "phone": "phone|call|tel|mobile|fax", "local_phone": "phone|call|tel|mobile|fax",
    "secret": "token|key|secret|passw|auth|bearer",
}
AGAINST = r"(?:version|section|chapter|page|isbn|doi|figure|no\.|sha|commit)[\x20:#]*$"

LABELERS = ["pattern", "gazetteer", "cue", "shape", "against"]
FEATURES = ["long", "digits", "quoted", "spread"]
#: Letters before a span that context labelers look at.
CONTEXT = 24


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _any(value: str, beginnings) -> str:
    return "(" + " or ".join(f"startswith({value}, {_text(b)})" for b in beginnings) + ")"


def _luhn(value: str) -> str:
    digits = _digits(value)
    return (f"aggregate(transform(split(reverse({digits}), ''), (d, i) -> "
            "if(i % 2 = 0, try_cast(d as int), try_cast(d as int) * 2 - if(try_cast(d as int) > 4, 9, 0))), "
            "0, (a, d) -> a + coalesce(d, 0)) % 10 = 0")


def _valid(kind: str, value: str) -> str:
    if kind == "ip":
        return (f"forall(split({value}, '[.]'), p -> length(ltrim('0', p)) <= 3 "
                "and coalesce(try_cast(p as decimal(38, 0)), 999) <= 255)")
    if kind == "card":
        return f"length({_digits(value)}) between 16 and 19 and {_luhn(value)}"
    if kind == "phone":
        return f"length({_digits(value)}) between 8 and 15"
    return "true"


def _votes(kind: str) -> dict[str, str]:
    """SQL of each labeler's vote (1, 0 or -1) on the span ``x``."""
    known = {
        "email": f"if(regexp_extract(x.value, '[.]([A-Za-z0-9-]+)$', 1) in ({', '.join(map(_text, DOMAINS))}), 1, 0)",
        "ip": "if(startswith(x.value, '0.') or startswith(x.value, '127.') or x.value = '255.255.255.255', -1, 1)",
        "card": f"if({_any('x.value', ISSUERS)}, 1, -1)",
        "phone": f"if({_any('x.value', COUNTRY_CODES)}, 1, 0)",
        "local_phone": "if(startswith(x.value, '000') or startswith(x.value, '(000'), -1, 0)",
        "secret": "if(x.value rlike '^(?:sk|pk|ghp|gho|AKIA|ASIA|xox[bp])', 1, 0)",
    }[kind]
    shape = {
        "email": "if(length(x.value) <= 64, 1, 0)",
        "ip": "1",
        "card": "if(x.value rlike '^[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4,7}$', 1, 0)",
        "phone": "if(x.value rlike '[0-9]{4}$', 1, 0)",
        "local_phone": "if(x.value rlike '^[(]', 1, 0)",
        "secret": "if(x.value rlike '^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$', 1, "
                  "if(x.value rlike '[-_].*[-_].*[-_]', -1, 0))",
    }[kind]
    return {
        "pattern": "1" if kind in BASE else "0",
        "gazetteer": known,
        "cue": f"if(lower(x.before) rlike {_text(CUES[kind])}, 1, 0)",
        "shape": shape,
        "against": f"if(lower(x.before) rlike {_text(AGAINST)}, -1, 0)",
    }


def _features() -> dict[str, str]:
    return {
        "long": "int(length(x.value) > 16)",
        "digits": f"int(length({_digits('x.value')}) * 2 > length(x.value))",
        "quoted": "int(right(x.before, 1) in ('\"', '\\'', '=', ':'))",
        "spread": "int(size(array_distinct(split(x.value, ''))) >= 8)",
    }


def _running(array: str, values: str, merge: str) -> str:
    """SQL: running sums or maxima, by doubling steps, so long lists cost n log n."""
    return (f"aggregate(sequence(0, int(ceil(log2(greatest(size({array}), 1))))), {values}, "
            f"(a, k) -> transform(a, (v, i) -> {merge.format('get(a, i - shiftleft(1, k))')}))")


def _ends(kind: str) -> str:
    """SQL: where each match ends, in code points, from the lengths of the matches and the gaps between them."""
    return _running(f"m_{kind}", f"transform(m_{kind}, (v, i) -> length(g_{kind}[i]) + length(v))",
                    "v + coalesce({}, 0)")


def _found(kind: str) -> str:
    """SQL: all matches of a kind with their end and the text just before them."""
    return (f"transform(m_{kind}, (v, i) -> named_struct('end', e_{kind}[i], 'value', v, 'before', "
            f"right(g_{kind}[i], {CONTEXT})))")


def proposals(df: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``df``) and ``spans``: every proposed span with votes and features.

    Base spans come first in the order of their kinds, each kind by start. Proposals of the other kinds that
    overlap a base span are left out. A null text counts as empty.
    """
    patterns = BASE | MORE
    step = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                     F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))

    def gated(kind, call, empty="cast(array() as array<string>)"):
        pattern, gate = patterns[kind]
        test = f"contains(_text, {_text(gate)})" if gate == "@" else f"_text rlike {_text(gate)}"
        return F.expr(f"if({test}, {call.format(_text(pattern))}, {empty})")

    step = step.select("row", "_text", *[gated(k, "regexp_extract_all(_text, {}, 0)").alias(f"m_{k}") for k in KINDS])
    step = step.select("row", *[f"m_{k}" for k in KINDS],
                       *[F.expr(f"if(size(m_{k}) = 0, cast(array() as array<string>), "
                                f"split(_text, {_text(patterns[k][0])}, -1))").alias(f"g_{k}") for k in KINDS])
    step = step.select("*", *[F.expr(_ends(k)).alias(f"e_{k}") for k in KINDS])
    step = step.select("row", *[F.expr(_found(k)).alias(f"f_{k}") for k in KINDS])
    step = step.select("row", *[F.expr(
        f"transform(filter(f_{k}, x -> {_valid(k, 'x.value')}), x -> named_struct("
        f"'kind', {i}, 'start', x.end - length(x.value), 'end', x.end, "
        + ", ".join(f"'{n}', {sql}" for n, sql in (_votes(k) | _features()).items())
        + "))").alias(f"s_{k}") for i, k in enumerate(KINDS)])
    base = ", ".join(f"s_{k}" for k in BASE)
    step = step.select("row", F.expr(f"concat({base})").alias("_base"), *[f"s_{k}" for k in MORE])
    clear = ", ".join(f"filter(s_{k}, x -> not exists(_base, b -> b.start < x.end and x.start < b.end))" for k in MORE)
    return step.select("row", F.expr(f"concat(_base, {clear})").alias("spans"))


def vote_counts(spans: DataFrame) -> list:
    """How often each pattern of kind, votes and features occurs: a bounded table."""
    names = ["kind", *LABELERS, *FEATURES]
    table = spans.select(F.explode("spans").alias("x")).groupBy(*[F.col("x").getField(n).alias(n) for n in names]).count()
    return table.orderBy(*names).collect()


def reliabilities(patterns: list, rounds: int = 50):
    """Expectation-maximisation: accuracy of each labeler per kind, share of true spans per kind, and the
    probability of each pattern. Votes are independent given the truth; a labeler that is silent says nothing.
    """
    kinds = sorted({p["kind"] for p in patterns})
    accuracy = {(k, n): 0.8 for k, n in product(kinds, LABELERS)}
    share = dict.fromkeys(kinds, 0.5)
    belief = {}
    for _ in range(rounds):
        for i, p in enumerate(patterns):
            odds = math.log(share[p["kind"]] / (1 - share[p["kind"]]))
            for n in LABELERS:
                a = accuracy[p["kind"], n]
                odds += p[n] * math.log(a / (1 - a))
            belief[i] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        for k in kinds:
            own = [(i, p) for i, p in enumerate(patterns) if p["kind"] == k]
            total = sum(p["count"] for _, p in own)
            share[k] = (1 + sum(p["count"] * belief[i] for i, p in own)) / (2 + total)
            for n in LABELERS:
                cast = [(p["count"], belief[i] if p[n] > 0 else 1 - belief[i]) for i, p in own if p[n]]
                # Two votes right and half a vote wrong beforehand, and better than chance: it keeps its sense.
                a = (2 + sum(c * b for c, b in cast)) / (2.5 + sum(c for c, _ in cast))
                accuracy[k, n] = min(0.99, max(0.55, a))
    return accuracy, share, [belief[i] for i in range(len(patterns))]


def _inputs(p) -> list[float]:
    return ([1.0] + [float(p["kind"] == i) for i in range(len(KINDS))] + [float(p[n]) for n in LABELERS]
            + [float(p[n]) for n in FEATURES])


def fit_classifier(patterns: list, rounds: int = 400, rate: float = 1.0, penalty: float = 1e-3) -> list[float]:
    """Weights of a logistic classifier trained on the probabilities of the patterns, weighted by count."""
    if not patterns:
        return [0.0] * (1 + len(KINDS) + len(LABELERS) + len(FEATURES))
    _, _, belief = reliabilities(patterns)
    # Frequent patterns would drown the rest: each weighs by the logarithm of its count.
    rows = [(_inputs(p), b, math.log1p(p["count"])) for p, b in zip(patterns, belief)]
    total = sum(w for _, _, w in rows)
    weights = [0.0] * len(rows[0][0])
    for _ in range(rounds):
        slope = [penalty * w for w in weights]
        for x, b, n in rows:
            z = sum(w * v for w, v in zip(weights, x))
            miss = (1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) - b) * n / total
            for j, v in enumerate(x):
                if v:
                    slope[j] += miss * v
        weights = [w - rate * g for w, g in zip(weights, slope)]
    return weights


def _accepted(weights: list[float]) -> str:
    """SQL over a span ``x``: a base kind, or the classifier's odds are for personal data."""
    names = [*LABELERS, *FEATURES]
    kinds = " + ".join(f"if(x.kind = {i}, {w!r}D, 0D)" for i, w in enumerate(weights[1:1 + len(KINDS)]))
    votes = " + ".join(f"x.{n} * {w!r}D" for n, w in zip(names, weights[1 + len(KINDS):]))
    return f"x.kind < {len(BASE)} or {weights[0]!r}D + {kinds} + {votes} > 0"


def find_private(df: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``df``) and ``spans``: what is personal data, by kind, then start.

    Counts the votes over all rows when it is called, then reads the rows a second time lazily. Spans are in code
    points, the end exclusive. A null or empty text has none; an empty table gives no rows. Columns of any
    name pass through inside ``row``.
    """
    found = proposals(df, text)
    weights = fit_classifier(vote_counts(found))
    return found.select("row", F.expr(f"transform(filter(spans, x -> {_accepted(weights)}), "
                                      "x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end))")
                        .alias("spans"))


def private_report(docs: DataFrame) -> DataFrame:
    """Per row of ``(doc_id, text)``: base spans counted and hashed, and all spans written out."""
    found = find_private(docs.select("doc_id", "text"))
    names = "array(" + ", ".join(map(_text, KINDS)) + ")"

    def written(spans):
        return f"array_join(transform({spans}, x -> concat_ws(':', {names}[x.kind], x.start, x.end)), ',')"

    base = f"filter(spans, x -> x.kind < {len(BASE)})"
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[F.expr(f"bigint(size(filter(spans, x -> x.kind = {i})))").alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(F.expr(written(base)).cast("binary"), 256).alias("base_sha256"),
        F.expr(written("spans")).alias("spans"))


def mask_private(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span of personal data in ``text`` replaced by ``<kind>``; all columns kept.

    A null text stays null. Overlapping spans are replaced together, under the kind that begins first.
    """
    names = "array(" + ", ".join(_text(f"<{k}>") for k in KINDS) + ")"
    found = find_private(df, text).select("row", F.expr(
        "array_sort(transform(spans, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind)))").alias("cuts"))
    # Runs of overlapping spans: one begins where no earlier span reaches.
    reach = found.select("row", "cuts", F.expr(
        _running("cuts", "transform(cuts, c -> c.end)", "greatest(v, coalesce({}, v))")).alias("reach"))
    runs = reach.select("row", "reach", F.expr(
        "filter(transform(cuts, (c, i) -> named_struct('start', c.start, 'kind', c.kind, 'from', "
        "coalesce(get(reach, i - 1), 0), 'new', i = 0 or c.start >= get(reach, i - 1))), c -> c.new)").alias("runs"))
    body = f"`{text}`"
    mask = F.expr(
        f"if(size(runs) = 0, row.{body}, concat(array_join(transform(runs, c -> concat("
        f"substring(row.{body}, c.from + 1, c.start - c.from), {names}[c.kind])), ''), "
        f"substring(row.{body}, array_max(reach) + 1)))")
    return runs.select(*[(mask if c == text else F.col("row").getField(c)).alias(c) for c in df.columns])
