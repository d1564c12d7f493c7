"""Secret scans: fixed patterns, and tokens that look more like random strings than like identifiers.

Everything is column expressions: no Python runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlemill.session import materialize

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run that is too short holds no longer one, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
IDENTIFIER = r"[A-Za-z0-9+/_=-]{4,}"
JUDGED = 20  # least length of TOKEN; runs that will be judged are no samples
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
FIT_DOCS = 20_000  # bound on the documents that ordinary identifiers are learnt from
PRIOR = 0.5  # added to each transition count
HELD_OUT = 4  # one labelled value in so many is held out to set the margin
LEAST_HELD = 8  # least length of held-out identifiers; shorter ones say little about tokens of JUDGED characters
STEP = 0.05  # nats per transition between the margins that are tried
SPAN = "array<struct<at:bigint,order:int,stop:bigint,value:string>>"


def matches(text: Column, pattern: str, order: int, value_group: int = 0) -> Column:
    """Leftmost matches of ``pattern`` as an array of (at, order, stop, value) in code points.

    The matches and the gaps between them alternate, so that running lengths give the positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = found if value_group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["pos"] + F.length(x["gap"])
        stop = at + F.length(x["found"])
        span = F.struct(at.alias("at"), F.lit(order).alias("order"), stop.alias("stop"), x["value"].alias("value"))
        return F.struct(stop.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    rows = F.zip_with(
        F.arrays_zip(found.alias("found"), value.alias("value")),
        F.slice(gaps, F.lit(1), F.size(found)),
        lambda m, g: F.struct(m["found"].alias("found"), m["value"].alias("value"), g.alias("gap")),
    )
    spans = F.aggregate(rows, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``assign``, ``access`` and ``hex``: arrays of spans of the fixed patterns."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({
        "assign": F.filter(matches(whole, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= 12),
        "access": matches(whole, ACCESS, 1),
        "hex": matches(whole, HEX, 2),
    })


def _code(char: Column) -> Column:
    """Place of an ASCII character in ``ALPHABET``, from 0; the last place for any other."""
    places = [len(ALPHABET)] * 128
    for k, c in enumerate(ALPHABET):
        places[ord(c)] = k
    table = F.array(*[F.lit(x) for x in places])
    return F.coalesce(F.try_element_at(table, F.ascii(char) + 1), F.lit(len(ALPHABET)))


def _pairs(value: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.length(value) - 1), lambda i: F.substring(value, i, F.lit(2))
    )


def samples(based: DataFrame, text: str = "text", fit_docs: int = FIT_DOCS) -> DataFrame:
    """Labelled values: ``value, secret`` (1 or 0), ``held`` (out).

    Values of the fixed patterns in all documents are the random strings. Runs of ``IDENTIFIER`` outside
    them, in at most about ``fit_docs`` documents chosen by a hash of the text, are the ordinary ones,
    except runs that are long enough to be judged: nobody has said what they are. Equal values fall on
    the same side.
    """
    share = min(1.0, fit_docs / max(1, based.count()))
    value = F.col("value")
    secret = based.select(F.explode(F.concat("assign", "access", "hex")).alias("s")).select(F.col("s.value").alias("value"), F.lit(1).alias("secret"))
    plain_text = F.regexp_replace(F.col(text), f"{ASSIGN}|{ACCESS}|{HEX}", " ")
    sampled = based.where(F.col(text).isNotNull()).where(
        F.pmod(F.xxhash64(F.col(text), F.lit(9)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    )
    plain = sampled.select(
        F.explode(F.regexp_extract_all(plain_text, F.lit(IDENTIFIER), F.lit(0))).alias("value"), F.lit(0).alias("secret")
    ).where(F.length(value) < JUDGED)
    both = secret.unionByName(plain).where(F.length(value) > 1)
    return both.withColumn("held", F.pmod(F.xxhash64(value, F.lit(17)), F.lit(HELD_OUT)) == 0)


def learn_markov(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios of character transitions, random strings against identifiers.

    The result has one number per pair of classes, a table whose size depends on the alphabet alone.
    Without samples both models are flat and all ratios are 0 for the missing side's share.
    """
    counts = {
        (r["secret"], r["pair"]): r["n"]
        for r in labelled.where(~F.col("held"))
        .withColumn("pair", F.explode(_pairs(F.col("value"))))
        .where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$"))
        .groupBy("secret", "pair").agg(F.count("*").alias("n"))
        .collect()  # at most 2 x alphabet squared rows
    }
    size = len(ALPHABET)
    out = []
    for a in ALPHABET:
        rows = {
            s: [counts.get((s, a + b), 0) + PRIOR for b in ALPHABET] for s in (0, 1)
        }
        sums = {s: sum(row) for s, row in rows.items()}
        out += [math.log(x / sums[1]) - math.log(y / sums[0]) for x, y in zip(rows[1], rows[0], strict=True)]
        out.append(0.0)
    return out + [0.0] * (size + 1)


def score(value: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of the transitions of ``value``."""
    size = len(ALPHABET) + 1
    table = F.array(*[F.lit(round(x, 6)) for x in ratios])
    total = F.aggregate(
        _pairs(value), F.lit(0.0),
        lambda acc, p: acc + F.element_at(
            table, (_code(F.substring(p, 1, 1)) * size + _code(F.substring(p, 2, 1)) + 1).cast("int")
        ),
    )
    return total / (F.length(value) - 1)


def learn_margin(labelled: DataFrame, ratios: list[float]) -> tuple[float, float, float]:
    """The margin, and the shares of held-out random strings and of held-out identifiers that it gets wrong.

    The margin is the middle of the scores between which the sum of both shares is least; 0, an even
    ratio, if a class has no held-out value.
    """
    held = labelled.where(F.col("held") & ((F.col("secret") == 1) | (F.length("value") >= LEAST_HELD)))
    cell = F.floor(score(F.col("value"), ratios) / STEP)
    counts: dict[int, list[int]] = {}
    for r in held.groupBy("secret", cell.alias("cell")).count().collect():  # log ratios are bounded by log of the counts
        counts.setdefault(int(r["cell"]), [0, 0])[r["secret"]] = r["count"]
    plain, random = (sum(c[k] for c in counts.values()) for k in (0, 1))
    if not plain or not random:
        return 0.0, float("nan"), float("nan")
    missed, passed, best = 0, plain, []
    for at in range(min(counts), max(counts) + 2):
        best.append((missed / random + passed / plain, at, missed / random, passed / plain))
        plain_here, random_here = counts.get(at, (0, 0))
        missed, passed = missed + random_here, passed - plain_here
    least = min(b[0] for b in best)
    equal = [b for b in best if b[0] == least]
    _, _, lost, wrong = equal[0]
    return STEP * (equal[0][1] + equal[-1][1]) / 2, lost, wrong


def scan(docs: DataFrame, text: str = "text", fit_docs: int = FIT_DOCS, margin: float | None = None) -> DataFrame:
    """``docs`` with the span arrays ``assign``, ``access``, ``hex`` and ``markov``.

    A ``markov`` span is a run of ``TOKEN`` that overlaps no fixed span and whose transitions
    favour the model of random strings by at least ``margin`` nats each on average; without one it is
    learnt from held-out labelled values (``learn_margin``).

    Null and empty texts have no spans. Repeated rows are scanned alike. Equal starts are ordered as
    in ``KINDS``. Columns named like a result are replaced. An empty table gives no rows.
    """
    based = base_spans(docs.drop(*KINDS), text)
    labelled = materialize(samples(based, text, fit_docs), "labelled")  # read for the model and for the margin
    ratios = learn_markov(labelled)
    if margin is None:
        margin = learn_margin(labelled, ratios)[0]
    whole = F.coalesce(F.col(text), F.lit(""))
    fixed = F.concat("assign", "access", "hex")

    def free(s: Column) -> Column:
        return ~F.exists(fixed, lambda x: (x["at"] < s["stop"]) & (s["at"] < x["stop"]))

    tokens = matches(whole, TOKEN, 3)
    return based.withColumn("markov", F.filter(tokens, lambda s: free(s) & (score(s["value"], ratios) >= margin)))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans by start and then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(
                ":", F.element_at(names, s["order"] + 1), s["at"].cast("string"), s["stop"].cast("string")
            ),
        ),
        ",",
    )
