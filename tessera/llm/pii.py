"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs the votes, a span classifier learns from the outcome.

DataFrame functions alone touch texts and spans.  What reaches the driver is
a count for each pattern of votes and features of a kind, which is bounded
by the number of features and not by the corpus.
"""

from __future__ import annotations

from math import exp, log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .linear import fit_dense

# Kinds in the order in which spans are listed, and the patterns that define base spans.
KINDS = ("email", "ip", "card", "phone")
#: Written so that a run of characters is tried once and a match never recurses: possessive loops, and starts only where a leftmost search can start.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates beyond base spans: spelt-out addresses, IPv6 and defanged addresses, numbers in groups of four whatever stands beside them
#: or their check digit says, numbers that a base match swallowed together with what follows, national numbers.
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}|(?<= )at(?= )) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\{dot\}|(?<= )dot(?= )) ?[A-Za-z0-9-]{2,63}+){1,4}+",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?<![0-9.\]])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9\[])",
    "card": r"(?<![0-9])(?:[0-9]{4}([\x20.-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([\x20-]?)[0-9]{6}\2[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+|00)[1-9][0-9]{0,2} ?\([0-9]{2,4}\) ?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])|(?<![0-9+])(?:\+|00)[1-9][0-9]{0,2}([\x20.-])[0-9]{2,4}(?:\1[0-9]{2,4}){1,3}(?![0-9])|(?<![0-9.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
}
#: What a text must hold for a pattern to be tried at all.
HINT = {"email": "@", "phone": "+"}
LOOSE_HINT = {"email": r"(?i)\bdot\b", "ip": r"(?i)[0-9a-f]:[0-9a-f]|[0-9]\[\.\][0-9]", "card": "[0-9]{4}", "phone": "[0-9]{3}"}

# Top-level domains, calling codes, issuer prefixes, networks of special use, words that stand beside personal data or beside other numbers.
DOMAINS = (
    "com org net edu gov mil int info biz name io ai app dev co me tv eu uk de fr es it nl be ch at pl pt se no fi dk ie cz sk hu ro bg gr hr si lt lv ee lu "
    "us ca mx br ar cl pe ve uy jp cn kr tw hk sg in id my th vn ph au nz za ng ke eg ma tn il tr ru ua by kz sa ae ir pk bd lk example test"
).split()
CALLING = "1|7|20|27|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1368]|2[2-6][0-9]|35[0-9]|37[0-9]|38[0-9]|42[013]|50[0-9]|59[0-9]|67[0-9]|68[0-9]|852|853|855|856|880|886|96[0-8]|97[0-9]|99[2-8]"
ISSUERS = "4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|36|38|6011|64[4-9]|65|35"
SPECIAL = r"0|127|22[4-9]|2[34][0-9]|25[0-5]|169\.254|192\.0\.2"
BESIDE = {
    "email": "e-?mails?|mail|mailto|contact|write|correo|kontakt|courriel|adresse|schreib",
    "ip": "ip|host|server|address|addr|from|login|client|serveur|servidor|dirección|adresse",
    "card": "card|visa|mastercard|amex|credit|debit|pay|carte|tarjeta|karte|kreditkarte|cvv",
    "phone": "tel|telephone|phone|call|mobile|cell|fax|whatsapp|sms|telefon|anruf|handy|appel|téléphone|teléfono|llam[ae]",
}
ELSEWHERE = "version|release|section|isbn|issn|order|invoice|ticket|serial|sku|sha|md5|uuid|token|password|key|hash|build|rev|commande|pedido|bestellung"

#: Letters of a candidate's surroundings that labelers read.
AROUND = 32
LABELERS = ("rule", "check", "gazetteer", "context", "edge", "shape")
MORE = ("line", "punctuated", "parted", "long", "cell", "named")
WIDTH = 2 * len(LABELERS) + len(MORE)


def _running(values: Column, merge, first: Column) -> Column:
    """Running merge of an array, each place included. Blocks of 256 are merged first, so that long arrays cost little more than short ones."""
    n = F.size(values)
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), ((n - 1) / 256).cast("int")), lambda b: F.slice(values, b * 256 + 1, F.lit(256)))).otherwise(F.array().cast("array<array<int>>"))

    def grown(xs: Column, start: Column) -> Column:
        return F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(merge(F.element_at(acc, -1), x))))

    starts = grown(F.transform(blocks, lambda b: F.aggregate(b, first, merge)), first)
    return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), lambda b, s: F.slice(grown(b, s), F.lit(2), F.lit(256))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits pass the check: every second from the right counts double, less 9 where that is over 9."""
    back = F.split(F.reverse(_digits(value)), "")
    total = F.aggregate(F.transform(back, lambda d, i: F.when(i % 2 == 1, F.translate(d, "0123456789", "0246813579")).otherwise(d).cast("int")), F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))
    return total % 10 == 0


_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _holds(kind: str, value: Column) -> Column:
    """The base rule's check of a match."""
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return _luhn(value)
    return F.length(_digits(value)).between(8, 15) if kind == "phone" else F.lit(True)


def _votes(kind: str, base: bool, value: Column, before: Column, after: Column) -> Column:
    """Bits of a candidate: a pair (for, against) of each labeler, then what else the classifier sees."""
    digits = _digits(value)
    spelt = F.regexp_replace(value, r"(?i) ?(?:[(\[{]dot[)\]}]|\bdot\b) ?", ".")
    good, bad = {}, {}
    good["rule"], bad["rule"] = F.lit(base), F.lit(not base)
    if kind == "email":
        good["check"] = spelt.rlike(r"(?i)^(?!.*\.\.)[A-Za-z0-9_%+-].{0,63}?(?:@| ?[(\[{]at[)\]}] ?| at )[A-Za-z0-9].*[A-Za-z]{2}$")
        good["gazetteer"] = F.lower(F.element_at(F.split(spelt, r"\."), -1)).isin(DOMAINS)
        good["shape"], bad["shape"] = value.rlike(r"(?i)@|[(\[{]at[)\]}]"), value.rlike("(?i) at ")
    elif kind == "ip":
        good["check"] = F.regexp_replace(value, r"\[\.\]", ".").rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$|:")
        good["gazetteer"] = ~value.rlike(rf"^0*(?:{SPECIAL})\b")
        good["shape"], bad["shape"] = value.rlike(r"[0-9]{2}"), value.rlike(r"(?:^|\.)0[0-9]")
    elif kind == "card":
        good["check"] = _luhn(value)
        good["gazetteer"] = digits.rlike(f"^(?:{ISSUERS})")
        good["shape"], bad["shape"] = value.rlike(r"^[0-9]{16}$|^[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$|^3[47]"), digits.rlike(r"^([0-9])\1+$|01234567")
    else:
        good["check"] = F.length(digits).between(8, 15)
        good["gazetteer"] = F.when(value.rlike(r"^(?:\+|00)"), value.rlike(rf"^(?:\+|00)(?:{CALLING})(?![0-9])|^(?:\+|00)(?:{CALLING})[0-9]{{6}}")).otherwise(value.rlike(r"^\(?[2-9][0-9]{2}"))
        good["shape"], bad["shape"] = value.rlike(r"\([0-9]{2,4}\)|^(?:\+|00)[0-9]+([\x20.-])[0-9]+(?:\1[0-9]+)+$"), value.rlike(r"[\x20.-]{2}|\([^)]*$") | digits.rlike(r"^([0-9])\1+$")
    for name in ("check", "gazetteer"):
        bad[name] = ~good[name]
    near = F.concat(before, F.lit(" "), after)
    good["context"], bad["context"] = near.rlike(rf"(?iu)\b(?:{BESIDE[kind]})\b"), near.rlike(rf"(?iu)\b(?:{ELSEWHERE})\b")
    joined = before.rlike(r"[\p{L}\p{N}_/@#=\"]$") | after.rlike(r"^[\p{L}\p{N}_/@\"]")
    good["edge"], bad["edge"] = ~joined, joined
    more = {
        "line": (F.length(before) == 0) | before.endswith("\n"),
        "punctuated": (F.length(after) == 0) | after.rlike(r"^[.,;:!?)\]\n]"),
        "parted": value.rlike(r"[\x20-]"),
        "long": F.length(value) > 19,
        "cell": before.rlike(r"\|\s*$"),
        "named": before.rlike(r"[:=]\s*$"),
    }
    bits = [b for name in LABELERS for b in (good[name], bad[name])] + [more[name] for name in MORE]
    total = F.lit(0)
    for j, b in enumerate(bits):
        total = total + F.when(b, 1 << j).otherwise(0)
    return total


def _found(df: DataFrame, text: str, name: str, pattern: str, hint: str | None, plain_hint: bool) -> DataFrame:
    """df with an array column `name` of (start, end, value, before, after) of the pattern's matches; places count code points, the end is exclusive."""
    has = F.lit(True) if hint is None else F.col(text).contains(hint) if plain_hint else F.col(text).rlike(hint)
    none = F.array().cast("array<string>")
    df = df.withColumn("_found", F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("_apart", F.when(F.size("_found") > 0, F.split(text, pattern, -1)).otherwise(none))
    count = F.size("_found")
    steps = F.zip_with(F.slice("_apart", F.lit(1), count), F.col("_found"), lambda a, m: F.length(a) + F.length(m))
    df = df.withColumn("_ends", _running(steps, lambda a, b: a + b, F.lit(0)))
    both = F.arrays_zip(F.col("_found").alias("m"), F.col("_ends").alias("e"), F.slice("_apart", F.lit(1), count).alias("a"), F.slice("_apart", F.lit(2), count).alias("b"))
    spans = F.transform(
        both,
        lambda z: F.struct(
            (z["e"] - F.length(z["m"])).alias("start"),
            z["e"].alias("end"),
            z["m"].alias("value"),
            F.right(z["a"], F.lit(AROUND)).alias("before"),
            F.left(z["b"], F.lit(AROUND)).alias("after"),
        ),
    )
    return df.withColumn(name, spans).drop("_found", "_apart", "_ends")


def _voted(found: Column, kind: str, base: bool) -> Column:
    """Matches of a kind as (start, end, kind, base, bits); base matches that fail the rule's check are dropped."""
    kept = F.filter(found, lambda s: _holds(kind, s["value"])) if base else found
    return F.transform(
        kept,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lit(KINDS.index(kind)).alias("kind"),
            F.lit(base).alias("base"),
            _votes(kind, base, s["value"], s["before"], s["after"]).alias("bits"),
        ),
    )


def candidates(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, spans) of each row: base spans, and loose candidates that no base span overlaps, as (start, end, kind, base, bits), by start."""
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = []
    for kind in KINDS:
        for base, patterns, hints in ((True, BASE, HINT), (False, LOOSE, LOOSE_HINT)):
            name = f"{kind}_{'base' if base else 'loose'}"
            df = _found(df, "text", name, patterns[kind], hints.get(kind), base)
            spans.append(_voted(F.col(name), kind, base))
    df = df.select("id", F.array_sort(F.concat(*spans)).alias("all"))
    ends = F.transform("all", lambda s: F.when(s["base"], s["end"]).otherwise(0))
    starts = F.transform("all", lambda s: F.when(s["base"], s["start"]).otherwise(2**31 - 1))
    df = df.select("id", "all", _running(ends, lambda a, b: F.greatest(a, b), F.lit(0)).alias("past"), F.reverse(_running(F.reverse(starts), lambda a, b: F.least(a, b), F.lit(2**31 - 1))).alias("next"))
    clear = F.filter(F.arrays_zip("all", "past", "next"), lambda z: z["all"]["base"] | (z["past"] <= z["all"]["start"]) & (z["next"] >= z["all"]["end"]))
    return df.select("id", F.transform(clear, lambda z: z["all"]).alias("spans"))


# Votes that count before any is seen: a labeler is for right spans, and against wrong ones, four times as often as the other way.
_PRIOR = {1: (4.0, 2.0, 1.0), 0: (1.0, 2.0, 4.0)}


def _vote(bits: int, j: int) -> int:
    """0: for, 1: no vote, 2: against."""
    good, bad = bits >> 2 * j & 1, bits >> 2 * j + 1 & 1
    return 1 if good == bad else 0 if good else 2


def reliabilities(counts: dict[int, float], steps: int = 40) -> tuple[dict[int, float], list[dict[int, tuple[float, ...]]]]:
    """Expectation-maximisation for one kind: (chance of being right of each pattern, of each labeler its shares of votes for right and for wrong spans).

    A labeler votes for, against or not at all, independently of the others
    once the truth is known; its shares start from a plain majority and from
    a few votes counted beforehand, which also keep right and wrong apart.
    """
    right = {b: 1 / (1 + exp(-sum(1 - _vote(b, j) for j in range(len(LABELERS))))) for b in counts}
    shares: list[dict[int, tuple[float, ...]]] = []
    for _ in range(steps):
        own = {c: 1 + sum(n * (right[b] if c else 1 - right[b]) for b, n in counts.items()) for c in (0, 1)}
        shares = []
        for j in range(len(LABELERS)):
            of = {}
            for c in (0, 1):
                seen = list(_PRIOR[c])
                for b, n in counts.items():
                    seen[_vote(b, j)] += n * (right[b] if c else 1 - right[b])
                of[c] = tuple(s / sum(seen) for s in seen)
            shares.append(of)
        new = {}
        for b in counts:
            odds = log(own[1] / own[0]) + sum(log(shares[j][1][_vote(b, j)] / shares[j][0][_vote(b, j)]) for j in range(len(LABELERS)))
            new[b] = 1 / (1 + exp(-max(-40.0, min(40.0, odds))))
        moved = max(abs(new[b] - right[b]) for b in counts)
        right = new
        if moved < 1e-6:
            break
    return right, shares


def fit(spans: DataFrame) -> list[list[float]]:
    """Weights of the span classifier, a list for each kind (the last weight is the intercept).

    Patterns of bits are counted over all candidates, at most 2^18 a kind,
    and only the counts are collected.  The classifier is a logistic model of
    votes and further features, fitted to the chances of being right.
    """
    each = spans.select(F.explode("spans").alias("s")).groupBy(F.col("s.kind").alias("kind"), F.col("s.bits").alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    counts: list[dict[int, float]] = [{} for _ in KINDS]
    for kind, bits, n in each.collect():
        counts[kind][bits] = float(n)
    out = []
    for own in counts:
        if not own:
            out.append([0.0] * WIDTH + [-1.0])
            continue
        right, _ = reliabilities(own)
        bits = sorted(own)
        x = np.array([[b >> j & 1 for j in range(WIDTH)] + [1] for b in bits], float)
        w = fit_dense(x, np.array([right[b] for b in bits]), np.array([own[b] for b in bits]))
        out.append([float(v) for v in w])
    return out


def classified(spans: DataFrame, weights: list[list[float]], threshold: float = 0.5) -> DataFrame:
    """(id, spans) with base spans and those candidates whose chance reaches the threshold; of candidates that overlap, the first by start, then end."""
    table = F.array(*[F.array(*[F.lit(v) for v in w]) for w in weights])
    least = log(threshold / (1 - threshold))

    def odds(s: Column) -> Column:
        own = F.element_at(table, s["kind"] + 1)
        on = F.aggregate(F.sequence(F.lit(0), F.lit(WIDTH - 1)), F.lit(0.0), lambda a, j: a + F.when(F.get(F.split(F.reverse(F.lpad(F.bin(s["bits"]), WIDTH, "0")), ""), j) == "1", F.get(own, j)).otherwise(0.0))
        return on + F.get(own, F.lit(WIDTH))

    kept = spans.select("id", F.filter("spans", lambda s: s["base"] | (odds(s) >= least)).alias("kept"))
    ends = F.transform("kept", lambda s: F.when(s["base"], 0).otherwise(s["end"]))
    kept = kept.select("id", "kept", _running(ends, lambda a, b: F.greatest(a, b), F.lit(0)).alias("past"))
    before = F.concat(F.array(F.lit(0)), F.col("past"))
    clear = F.filter(F.arrays_zip("kept", before.alias("before")), lambda z: z["kept"].isNotNull() & (z["kept"]["base"] | (z["before"] <= z["kept"]["start"])))
    return kept.select("id", F.transform(clear, lambda z: F.struct(z["kept"]["kind"].alias("kind"), z["kept"]["start"].alias("start"), z["kept"]["end"].alias("end"), z["kept"]["base"].alias("base"))).alias("spans"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row, over its whole text.

    Counts and digest are those of the base rules.  `spans` lists base spans
    and those that the classifier adds, as kind:start:end in code points.  A
    null text counts as empty; an empty text has no spans and the digest of
    the empty string.  Repeated rows each count and each give a row; rows
    without an id too.  An empty table gives no rows.  Other columns are not
    read.  Candidates of all rows are kept in a scratch table without their
    texts, so each text is read once.
    """
    found = stored(candidates(docs, id_col, text), "pii-candidates")
    names = F.array(*[F.lit(k) for k in KINDS])

    def listed(spans: Column) -> Column:
        parts = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
        return F.array_join(F.transform(parts, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    got = classified(found, fit(found), threshold).withColumn("base", F.filter("spans", lambda s: s["base"]))

    def count(no: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == no)).cast("bigint").alias(f"n_{KINDS[no]}")

    return got.select(F.col("id").alias(id_col), *map(count, range(len(KINDS))), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
