"""Secret scans: fixed patterns, and a battery of randomness tests for tokens that no pattern knows.

Only built-in functions are used.  A pattern's matches come from regexp_extract_all, and their places (in code points)
from the lengths of what split leaves between them, added up in blocks.

Battery.  What is tested: the values of assignments, access and hex matches, and every run of base-64 characters in
what assignments leave of the text, each of at least SHORTEST characters with a digit and a letter among them.  The
encoding is inferred (hex, base 32, base 36, base 62, base 64: the smallest alphabet that holds the token) and the
characters become numbers below the alphabet's size k.  Under independent, uniform characters:
  chi-squared    the number of equal pairs; upper tail of the gamma law with its exact mean, variance and skewness;
  runs           neighbours in different halves of the alphabet, which is binomial with one half; two-sided;
  correlation    sum of cosines of neighbours' differences on a circle of k, which are independent and uniform; two-sided.
The tails of the last two are normal with the exact fourth cumulant's correction.  The first two are counts: their
p-values are made continuous by a number from the token's own hash, so they are uniform to within sampling error from
20 characters on.  The least of the three, as of three independent ones, is the token's p-value.

False discoveries.  A token is reported as random if its p-value is over a threshold of its stratum of length.  Random
tokens have uniform p-values, ordinary ones crowd towards zero.  From the count of p-values over LEVEL, less the ordinary
ones that the band below 0.1 lets expect there and less a standard error, the number of random tokens is estimated, and
from it, for each threshold, the share of reported tokens that are not random; where many tokens show no ordinary one in the band,
all p-values above it count instead.  The lowest threshold is taken at which, as at all higher ones, that share is at most
FALSE_RATE; where it is more even over LEVEL (few random tokens among many), nothing is reported.  It comes from counts of p-values in fine
bins, so the driver sees one row a stratum and no task sees more than the bins.

Base spans stay whatever their verdict; tokens outside them that are reported are added as spans of the kind `random`.

Nulls: a null text scans as an empty one.  Repeated documents are scanned each and their tokens count each.  An
empty table gives no rows.  Other columns are ignored by `scan` and kept by `redact`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryloom.llm.common import cut, free_name
from quarryloom.sources.tables import spread

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The same matches as of AKIA[A-Z0-9]+ and [0-9a-f]+ that are long enough: a run that is too short holds no longer one.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
TOKEN = "[A-Za-z0-9+/_-]{20,}={0,2}"
VALUE = 12
SHORTEST = 20
#: Order of kinds; a tested token is of one of them.
KINDS = ("assign", "access", "hex", "random")
#: Lengths at which a stratum begins.
STRATA = (20, 24, 32, 48, 96)
FALSE_RATE = 0.05
#: Bins of the logarithm of p: their width, their number, and those whose p-values are nearly all of random tokens (p over LEVEL).
BIN, BINS, SURE = 0.05, 1200, 14
LEVEL = math.exp(-BIN * SURE)
#: Of random tokens the share over LEVEL is up to EVEN of an even one, as p-values are discrete.  Ordinary tokens over LEVEL are taken to be TAIL of
#: those in the bins of BAND (p from 0.05 to 0.1) at most: their p-values crowd towards zero.
EVEN, BAND, TAIL = 0.94, (46, 59), 0.16
#: Tokens above the band from which it can be called empty of ordinary ones, and the shares of the rate that are used then, and else for thresholds under LEVEL: the best of many is taken.
ENOUGH, CLEAN, FURTHER = 30, 0.4, 0.8
BLOCK = 256
MASK = "[REDACTED]"

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_TYPE = "array<struct<start:long,end:long,match:string>>"


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as array<struct<start, end, match>>."""
    zipped = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda m, before: F.struct(m.alias("m"), before.alias("b")))
    found = F.filter(zipped, lambda x: x["m"].isNotNull())
    nothing = F.expr(f"cast(array() as {_TYPE})")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["b"])
        end = start + F.char_length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("match")))).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), nothing.alias("out")), step)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    # blocks, as a list that grows by one element is copied each time
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda k: F.slice(found, k * BLOCK + 1, F.lit(BLOCK)))
    whole = F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as array<{_TYPE}>)").alias("out")), block)
    return F.when(text.rlike(pattern), F.flatten(whole["out"])).otherwise(nothing)


def _normal_tail(z: Column) -> Column:
    """P(Z > z), from a rational approximation of the error function (error below 1e-7)."""
    t = 1 / (1 + 0.3275911 * F.abs(z) / math.sqrt(2))
    upper = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-z * z / 2) / 2
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _both_tails(z: Column, fourth: Column) -> Column:
    """P(|Z| > |z|) for a standardised symmetric Z with that fourth cumulant."""
    z = F.abs(z)
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-300), 2 * (_normal_tail(z) + F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * fourth / 24 * (z * z * z - 3 * z))))


def encoding(token: Column) -> Column:
    """The smallest alphabet of ALPHABETS that holds the token."""
    body = F.rtrim(token, F.lit("="))
    out = F.lit("base64url")
    for name, chars in reversed(list(ALPHABETS.items())[:-1]):
        out = F.when(body.rlike("^[" + chars.replace("-", r"\-").replace("/", r"\/") + "]+$"), F.lit(name)).otherwise(out)
    return out


def _bound(value: Column, of) -> Column:
    """of(value), with the value computed once, through a one-element array."""
    return F.element_at(F.transform(F.array(value), of), 1)


def battery(token: Column) -> Column:
    """struct<code, p>: the token's encoding, and its combined p-value under independent, uniform characters of it."""
    code = encoding(token)
    alphabet = F.element_at(F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair]), code)
    total = lambda array: F.aggregate(array, F.lit(0.0), lambda a, b: a + b)
    unit = lambda seed: (F.pmod(F.xxhash64(token, F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)

    def of(x: Column) -> Column:
        v, k, n = x["v"], x["k"], F.size(x["v"]).cast("double")
        m, p, pairs = n - 1, 1 / k, n * (n - 1) / 2
        same = total(F.transform(F.array_distinct(v), lambda d: _bound(F.size(F.filter(v, lambda y: y == d)).cast("double"), lambda c: c * (c - 1) / 2)))
        variance = pairs * p * (1 - p)
        skew = (variance * (1 - 2 * p) + n * m * (n - 2) * p * p * (1 - p)) / F.pow(variance, F.lit(1.5))
        shape = 4 / (skew * skew)
        scaled = F.greatest(1 + (same + 0.5 - unit(1) - pairs * p) / F.sqrt(variance) / F.sqrt(shape), F.lit(1e-9))
        p_chi = _normal_tail(3 * F.sqrt(shape) * (F.cbrt(scaled) - 1 + 1 / (9 * shape)))
        neighbours = F.arrays_zip(F.slice(v, 1, F.size(v) - 1).alias("a"), F.slice(v, 2, F.size(v) - 1).alias("b"))
        changes = F.size(F.filter(neighbours, lambda y: (y["a"] >= k / 2) != (y["b"] >= k / 2)))
        p_runs = _both_tails(F.greatest(F.abs(changes - m / 2) + 0.5 - unit(2), F.lit(0.0)) / F.sqrt(m / 4), -2 / m)
        p_serial = _both_tails(total(F.transform(neighbours, lambda y: F.cos(2 * math.pi * (y["b"] - y["a"]) / k))) / F.sqrt(m / 2), -1.5 / m)
        return F.struct(x["code"].alias("code"), (1 - F.pow(1 - F.least(p_chi, p_runs, p_serial), F.lit(3.0))).alias("p"))

    values = F.transform(F.split(F.rtrim(token, F.lit("=")), ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
    return _bound(F.struct(F.filter(values, lambda y: y >= 0).alias("v"), F.length(alphabet).cast("double").alias("k"), code.alias("code")), of)


_TOKEN_TYPE = "array<struct<start:long,end:long,match:string,kind:int>>"


def _tokens(text: Column, assign: Column, access: Column, hex_: Column) -> Column:
    """What is tested: values of base matches, and tokens of what assignments (of any length) leave, by place and kind."""
    of = lambda start, m: F.struct(start.alias("start"), m["end"].alias("end"), F.substr(m["match"], start - m["start"] + 1).alias("match"))
    values = F.transform(F.filter(assign, lambda m: F.char_length(F.regexp_extract(m["match"], ASSIGN, 2)) >= SHORTEST), lambda m: of(m["end"] - F.char_length(F.regexp_extract(m["match"], ASSIGN, 2)), m))
    whole = lambda found: F.array_except(F.transform(F.filter(found, lambda m: F.char_length(m["match"]) >= SHORTEST), lambda m: of(m["start"], m)), values)
    kind = lambda found, k: F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match"), F.lit(k).alias("kind")))
    # the text between assignments, each part with its place
    parts = F.zip_with(F.split(text, ASSIGN, -1), F.concat(F.array(F.lit(0).cast("long")), F.transform(assign, lambda m: m["end"])), lambda part, at: F.struct(part.alias("part"), at.alias("at")))
    long_ones = F.filter(parts, lambda x: F.char_length(x["part"]) >= SHORTEST)
    free = F.flatten(F.transform(long_ones, lambda x: F.transform(matches(x["part"], TOKEN), lambda m: F.struct((m["start"] + x["at"]).alias("start"), (m["end"] + x["at"]).alias("end"), m["match"].alias("match")))))
    # one that holds a hex or access match is not added beside that span
    alone = F.filter(free, lambda m: ~m["match"].rlike(f"{HEX}|{ACCESS}"))
    every = F.concat(*[x.cast(_TOKEN_TYPE) for x in (kind(values, 0), kind(whole(access), 1), kind(whole(hex_), 2), kind(alone, 3))])
    return F.filter(every, lambda m: m["match"].rlike("[0-9]") & m["match"].rlike("[A-Za-z]"))


def _scanned(rows: DataFrame, text: Column, prefix: str = "") -> DataFrame:
    """The rows with assign, access, hex (arrays of spans) and tokens (array of span, kind, encoding, p, stratum and bin of p)."""
    span = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
    assign, access, hex_, tokens = (f"{prefix}{n}" for n in ("assign", "access", "hex", "tokens"))
    own = [F.col(f"`{c}`") for c in rows.columns if c not in (assign, access, hex_, tokens)]

    def judged(m: Column) -> Column:
        stratum = sum((F.char_length(m["match"]) >= s).cast("int") for s in STRATA)
        return _bound(battery(m["match"]), lambda t: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"), t["code"].alias("code"), t["p"].alias("p"), stratum.alias("stratum"),
            F.least(F.floor(-F.log(F.greatest(t["p"], F.lit(1e-300))) / BIN), F.lit(BINS - 1)).cast("int").alias("bin"),
        ))

    first = rows.select(*own, matches(text, ASSIGN).alias(assign), matches(text, ACCESS).alias(access), matches(text, HEX).alias(hex_))
    second = first.select(*own, assign, access, hex_, _tokens(text, F.col(assign), F.col(access), F.col(hex_)).alias(tokens))
    return second.select(
        *own,
        F.transform(F.filter(assign, lambda m: F.char_length(F.regexp_extract(m["match"], ASSIGN, 2)) >= VALUE), span).alias(assign),
        F.transform(access, span).alias(access),
        F.transform(hex_, span).alias(hex_),
        F.transform(tokens, judged).alias(tokens),
    )


def candidates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns: doc_id, assign, access, hex, tokens: one row for each row."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return _scanned(rows, F.col("text")).drop("text")


def acceptance(found: DataFrame, rate: float = FALSE_RATE, tokens: str = "tokens") -> dict[int, int]:
    """For each stratum of length the last bin (of p over exp(-(bin + 1) * BIN)) whose tokens are reported as random."""
    counts = found.select(F.explode(tokens).alias("t")).groupBy("t.stratum", "t.bin").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("stratum")
    within = lambda low, high: F.sum(F.when(F.col("bin").between(low, high), F.col("n")).otherwise(0)).over(by)
    share = lambda b: 1 - F.exp(-(b + 1) * BIN)
    seen = counts.select("stratum", "bin", within(0, SURE - 1).alias("sure"), within(*BAND).alias("band"), within(0, BAND[0] - 1).alias("wide"), F.sum("n").over(by.orderBy("bin")).alias("reported"))
    width = lambda low, high: math.exp(-low * BIN) - math.exp(-(high + 1) * BIN)
    due = F.col("sure") / (1 - LEVEL) * width(*BAND)
    # ordinary tokens among the sure ones: so many at most for each in the band beyond the random ones there
    first = seen.withColumn("ordinary", F.greatest(F.lit(0.0), F.col("band") - EVEN * due) * TAIL)
    # where the band shows none of them, all p-values above it count; otherwise those over LEVEL do, less a standard error
    first = first.withColumn("clean", (F.col("wide") >= ENOUGH) & (F.col("band") <= due + 2 * F.sqrt(due)))
    careful = (EVEN * F.greatest(F.lit(0.0), F.col("sure") - F.col("ordinary")) - F.sqrt(F.col("sure") * LEVEL)) / (1 - LEVEL)
    ranked = first.withColumn("random", F.when(F.col("clean"), F.col("wide") / width(0, BAND[0] - 1)).otherwise(careful))
    beyond = F.col("reported") - F.col("random") * share(F.col("bin"))
    # below SURE all or none are reported, by what holds for all of them
    strict = F.when(F.col("bin") < SURE, F.col("ordinary") > rate * F.col("sure")).otherwise(F.greatest("ordinary", beyond) > rate * FURTHER * F.col("reported"))
    judged = ranked.withColumn("false", F.when(F.col("clean"), (F.col("bin") >= BAND[0]) & (beyond > rate * CLEAN * F.col("reported"))).otherwise(strict))
    upto = judged.withColumn("bad", F.max("false").over(by.orderBy("bin")))
    return {r.stratum: r.bin for r in upto.where("not bad and sure > 0").groupBy("stratum").agg(F.max("bin").alias("bin")).collect()}


def random_by(thresholds: dict[int, int], token: Column) -> Column:
    """Whether a tested token is reported as random."""
    if not thresholds:
        return F.lit(False)
    return F.coalesce(token["bin"] <= F.element_at(F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair]), token["stratum"]), F.lit(False))


def _spans(thresholds: dict[int, int], prefix: str = "") -> Column:
    of = lambda k, column: F.transform(column, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))
    return F.array_sort(F.concat(*[of(k, F.col(f"{prefix}{n}")) for k, n in enumerate(("assign", "access", "hex"))], of(3, F.filter(f"{prefix}tokens", lambda t: (t["kind"] == 3) & random_by(thresholds, t)))))


def scan(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns: doc_id, spans (array of start, kind, end; sorted; kinds as numbers in the order of KINDS), tested (array of start, end, kind, code, p, random)."""
    found = cut(candidates(docs, id_column=id_column, text_column=text_column))
    thresholds = acceptance(found)
    tested = F.transform(F.array_sort("tokens"), lambda t: F.struct(*[t[c].alias(c) for c in ("start", "end", "kind", "code", "p")], random_by(thresholds, t).alias("random")))
    return found.select("doc_id", _spans(thresholds).alias("spans"), tested.alias("tested"))


def redact(docs: DataFrame, *, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """The rows with every span in their texts replaced by MASK, and the texts' lengths counted anew."""
    prefix = free_name(docs, "scanned_assign").removesuffix("assign")
    text = F.coalesce(F.col(text_column), F.lit(""))
    # scanned once: the rows with what was found in them are written, and read again for the thresholds and for the masks
    scanned = cut(_scanned(docs, text, prefix))
    thresholds = acceptance(scanned, tokens=f"{prefix}tokens")
    spans = free_name(docs, "scanned_spans")
    found = scanned.withColumn(spans, _spans(thresholds, prefix))
    hit = F.size(spans) > 0
    out = found.withColumn(text_column, F.when(hit, masked(text, F.col(spans))).otherwise(F.col(text_column)))
    if length_column in docs.columns:
        out = out.withColumn(length_column, F.when(hit, F.char_length(text_column).cast(docs.schema[length_column].dataType)).otherwise(F.col(length_column)))
    return out.select(docs.columns)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every maximal union of overlapping spans replaced by MASK."""
    joined = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("out")),
        lambda acc, x: F.when(x["end"] <= acc["at"], acc).otherwise(
            F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(F.when(x["start"] < acc["at"], F.lit("")).otherwise(F.concat(text.substr((acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit(MASK))))).alias("out"))
        ),
    )
    rest = F.element_at(F.transform(F.array(joined), lambda j: F.concat(F.array_join(j["out"], ""), text.substr((j["at"] + 1).cast("int"), F.char_length(text)))), 1)
    return F.when(F.size(spans) == 0, text).otherwise(rest)


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    found = scan(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    shown = lambda t: F.concat_ws(":", t["start"].cast("string"), t["end"].cast("string"), t["code"], F.format_number(t["p"], 6), F.when(t["random"], "random").otherwise("ordinary"))
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed(F.filter("spans", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size("tested").cast("long").alias("n_tested"),
        F.size(F.filter("tested", lambda t: t["random"])).cast("long").alias("n_random"),
        F.array_join(F.transform("tested", shown), ",").alias("tested"),
    )
