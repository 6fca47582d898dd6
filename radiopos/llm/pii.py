"""Personal data by candidate gradient boosting, in DataFrame, SQL and JVM functions only.

Base spans follow fixed rules: leftmost non-overlapping matches of one pattern a kind, those that fail their test
(an IP part over 255, Luhn, number of digits) dropped. High-recall generators then propose further spans that may
overlap, some of them several a kind: addresses with signs spelt out or in brackets, cards with other separators or
beside other numbers, phones without a plus or beside other numbers. Boosted trees score a candidate by its format and
its context. Candidates at or above their kind's threshold that touch no base span are added, best score first.

Training needs no labelled table. A bounded sample of excerpts of the documents (DOCS documents, a parameter) gets
injected strings, drawn by hash from FORMS: personal data in known forms, and look-alikes. A candidate's label is 1 if
it is exactly an injected or a base span of its kind, else 0; so natural text beside the injections, parts of a span
and spans that reach too far are negatives too. The trees learn from three quarters of the documents; on the other
quarter an isotonic regression a kind turns their sums into probabilities, and the threshold is the least sum with a
probability of PRECISION. The trees become one CASE expression, so all documents take one pass without a shuffle.

Patterns are linear in the text: possessive loops, and starts only where a run of characters starts.

Cases: a null text equals the empty text and has no spans; repeated rows give the same row each; an empty table
gives no rows, and too few training rows of either label add no spans. Other columns stay as
they are, but those named like one that `detect` adds or uses are replaced. n_email, n_ip,
n_card and n_phone count base spans; `spans` has base and added ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Sampled documents, forms injected into each, and training candidates at most.
DOCS, FORMS_EACH, SAMPLE = 2_000, 8, 30_000
PRECISION = 0.9
TREES, DEPTH = 16, 4
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no base match of the kind.
_SIGN = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_AT = r"(?:\x20?(?:@|[\[({<]\x20?(?:at|AT|@)\x20?[\])}>])\x20?|\x20(?:at|AT)\x20)"
_DOT = r"(?:\.|\x20?[\[({<]\x20?(?:dot|DOT|\.)\x20?[\])}>]\x20?|\x20(?:dot|DOT)\x20)"
_WORD, _LABEL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++", r"[A-Za-z0-9-]++"
_OCTET = r"[0-9]{1,3}+"
GENERATORS = (
    ("email", rf"{_WORD}{_AT}{_LABEL}(?:{_DOT}{_LABEL})++"),
    ("ip", rf"(?<![0-9.]){_OCTET}(?:(?:\x20?\.\x20?|-|\x20?[\[({{<]\x20?(?:dot|DOT|\.)\x20?[\])}}>]\x20?|\x20(?:dot|DOT)\x20){_OCTET}){{3}}"),
    ("card", r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}[0-9]){12,18}+"),
    ("card", r"(?<![0-9])(?:[0-9]{4}[\x20./_-]{0,2}){3}[0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9])[+(]?[0-9](?:[\x20()./-]{0,2}[0-9]){8,14}+"),
    ("phone", r"(?<![0-9])(?:(?:\+|00)[0-9]{1,3}[\x20./-]?)?(?:\([0-9]{2,4}\)|[0-9]{3})[\x20./-]?[0-9]{3}[\x20./-]?[0-9]{4}(?![0-9])"),
)
#: Texts without this have no candidates of the generators: an address sign, or seven digits close together, or four numbers.
_SPELT = r"@|[\[({<]\x20?(?:at|AT)\x20?[\])}>]|\x20(?:at|AT)\x20[A-Za-z0-9-]++(?:\.[A-Za-z0-9]|\x20?[\[({<]?\x20?(?:dot|DOT))"
_NUMBERS = r"[0-9](?:[^0-9A-Za-z]{0,3}[0-9]){8}|[0-9]{1,3}(?:[^0-9]{1,7}[0-9]{1,3}){3}"
_SPAN = "array<struct<s:int,e:int,m:string>>"
FEATURES = ("kind_no", "digits", "letters", "signs", "groups", "longest", "shortest", "length", "plus", "zeros", "spelt_at", "sign_at", "dots", "spaces", "brackets", "tail", "valid", "left_word", "right_word", "left_number", "right_number", "left_sign", "hint", "capital")
_HINT = r"(?i)(?:mail|phone|tel|call|fax|contact|card|visa|ip|host|server|address|reach|write)\W{0,3}$"


def _hits(pattern: str, sign: str) -> Column:
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    return F.when(F.contains("text", F.lit(sign)), found).otherwise(F.array().cast("array<string>")) if sign else found


def _placed(hits: str, pattern: str) -> Column:
    """The hits with their places, in code points: pieces between the hits tell where each starts."""
    none = F.array().cast(_SPAN)

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["piece"])
        end = start + F.length(x["hit"])
        one = F.array(F.struct(start.alias("s"), end.alias("e"), x["hit"].alias("m")))
        return F.when(x["hit"].isNull(), state).otherwise(F.struct(end.alias("at"), F.concat(state["found"], one).alias("found")))

    both = F.arrays_zip(F.split("text", pattern, -1).alias("piece"), F.col(hits).alias("hit"))
    walked = F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda x: x["found"])
    return F.when(F.size(hits) > 0, walked).otherwise(none)


def _luhn(m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.least(F.length(digits), F.lit(19))), F.lit(0), add)
    return F.length(digits).between(13, 19) & (total % 10 == 0)


def _valid(kind: str, m: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    if kind == "ip":
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _held(kind: str) -> Column:
    return F.filter(f"base_{kind}", lambda x: _valid(kind, x["m"]))


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with one array of spans (s, e, m) a kind: base_email and so on. `text` is not null any more."""
    docs = docs.drop("candidates", "spans", "_added", "_some", *(f"{p}_{k}" for p in ("hits", "base") for k in KINDS), *(f"{p}_{i}" for p in ("hits", "gen") for i in range(len(GENERATORS))))
    out = docs.withColumn("text", common.text_of())
    out = out.select("*", *(_hits(BASE[k], _SIGN[k]).alias(f"hits_{k}") for k in KINDS))
    out = out.select(*docs.columns, *(_placed(f"hits_{k}", BASE[k]).alias(f"base_{k}") for k in KINDS))
    return out.select(*docs.columns, *(_held(k).alias(f"base_{k}") for k in KINDS))


def _features(kind: str, c: Column) -> dict[str, Column]:
    plain = F.regexp_replace(F.regexp_replace(c["m"], _AT, "@"), _DOT, ".") if kind == "email" else F.regexp_replace(c["m"], r"[^0-9]+", ".") if kind == "ip" else c["m"]
    left, right = F.substring(F.col("text"), F.greatest(c["s"] - 23, F.lit(1)), F.least(c["s"], F.lit(24))), F.substring(F.col("text"), c["e"] + 1, F.lit(3))
    count = lambda p: F.regexp_count(c["m"], F.lit(p))
    flag = lambda text, p: text.rlike(p).cast("int")
    sizes = F.transform(F.regexp_extract_all(c["m"], F.lit("[0-9]+"), F.lit(0)), F.length)
    valid = _valid(kind, plain).cast("int") if kind != "email" else flag(plain, r"^[^@]+@[^@]+\.[A-Za-z]{2,6}$")
    return {
        "kind_no": F.lit(KINDS.index(kind)), "digits": count("[0-9]"), "letters": count("[A-Za-z]"), "signs": count("[^0-9A-Za-z]"), "groups": F.size(sizes),
        "longest": F.coalesce(F.array_max(sizes), F.lit(0)), "shortest": F.coalesce(F.array_min(sizes), F.lit(0)), "length": F.length(c["m"]), "plus": flag(c["m"], r"^\+"), "zeros": flag(c["m"], "^00"),
        "spelt_at": flag(c["m"], r"(?i)[^A-Za-z0-9]at[^A-Za-z0-9]"), "sign_at": count("@"), "dots": count(r"\."), "spaces": count(" "), "brackets": count(r"[\[\](){}<>]"),
        "tail": F.length(F.regexp_extract(plain, r"([A-Za-z]*)$", 1)), "valid": valid, "left_word": flag(left, r"[A-Za-z_]$"), "right_word": flag(right, r"^[A-Za-z_@]"), "left_number": flag(left, r"[0-9][^A-Za-z0-9]{0,2}$"), "right_number": flag(right, r"^[^A-Za-z0-9]{0,2}[0-9]"),
        "left_sign": flag(left, r"[^A-Za-z0-9\s(\[\"'<:]$"), "hint": flag(left, _HINT), "capital": flag(right, r"^\s*[A-Z]"),
    }


def candidates(docs: DataFrame) -> DataFrame:
    """base_spans with `candidates`: kind_no, s, e, m and the other features; those equal to a base span as well."""
    based = base_spans(docs)
    some = {"email": F.col("text").rlike(_SPELT), "other": F.col("text").rlike(_NUMBERS)}
    out = based.withColumn("_some", F.struct(*(c.alias(k) for k, c in some.items())))
    hits = lambda k, p: F.when(F.col("_some")["email" if k == "email" else "other"], F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>"))
    out = out.select("*", *(hits(k, p).alias(f"hits_{i}") for i, (k, p) in enumerate(GENERATORS)))
    out = out.select(*based.columns, *(_placed(f"hits_{i}", p).alias(f"gen_{i}") for i, (_, p) in enumerate(GENERATORS)))

    def described(i: int, kind: str) -> Column:
        return F.transform(f"gen_{i}", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["m"].alias("m"), *(v.cast("double").alias(n) for n, v in _features(kind, c).items())))

    return out.select(*based.columns, F.concat(*(described(i, k) for i, (k, _) in enumerate(GENERATORS))).alias("candidates"))


def _forms() -> list[tuple[str, Column]]:
    """(kind, or '' for a look-alike; the string to inject). Digits and names are hashed from `doc_id` and the text."""
    number = lambda n, salt: F.lpad(F.pmod(F.xxhash64("excerpt", F.lit(salt)), F.lit(10**n)).cast("string"), n, "0")
    octet = lambda salt: F.pmod(F.xxhash64("excerpt", F.lit(salt)), F.lit(256)).cast("string")
    pick = lambda salt, *of: F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.xxhash64("excerpt", F.lit(salt)), F.lit(len(of))) + 1).cast("int"))
    word = lambda salt: F.coalesce(F.get("words", F.pmod(F.xxhash64("excerpt", F.lit(salt)), F.greatest(F.size("words"), F.lit(1))).cast("int")), F.lit("name"))
    join = lambda sign, parts: reduce(lambda a, b: F.concat(a, sign if isinstance(sign, Column) else F.lit(sign), b), parts)
    user = F.concat(word("u"), pick("us", ".", "_", "", "-"), number(2, "un"))
    site, end = F.concat(word("d"), pick("dn", "", "7", "-net")), pick("t", "com", "org", "net", "de", "co.uk", "fr")
    at, dot = pick("at", " [at] ", " (at) ", "(at)", "[at]", " {at} ", " at ", " AT ", " [AT] ", "<at>", " @ ", "[@]"), pick("dot", " [dot] ", "(dot)", " (dot) ", "[dot]", " dot ", " DOT ", "[.]")
    octets = [octet(f"o{i}") for i in range(4)]
    fifteen = F.concat(pick("c0", "3", "4", "5", "6"), number(14, "c1"))
    cards = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(fifteen, d.cast("string")))
    card, wrong = F.get(F.filter(cards, _luhn), F.lit(0)), F.get(F.filter(cards, lambda m: ~_luhn(m)), F.lit(3))
    grouped = lambda c, sign: join(sign, [F.substring(c, 4 * i + 1, 4) for i in range(4)])
    odd = pick("cs", ".", "/", "_", "  ", " - ", "--")
    area, three, four = F.concat(pick("p0", "2", "4", "7", "9"), number(2, "p1")), number(3, "p3"), number(4, "p4")
    country = pick("cc", "1", "33", "44", "49", "351")
    small = number(2, "n2")
    return [
        ("email", F.concat(user, F.lit("@"), site, F.lit("."), end)),
        *[("email", F.concat(user, at, site, dot, end))] * 3,
        *[("email", F.concat(user, at, site, F.lit("."), end))] * 2,
        ("ip", join(".", octets)),
        *[("ip", join(pick("is", "[.]", "(.)", " dot ", "[dot]", " . ", "(dot)", " [.] ", " (dot) "), octets))] * 3,
        ("card", card),
        ("card", grouped(card, pick("cb", " ", "-"))),
        *[("card", grouped(card, odd))] * 2,
        ("phone", F.concat(F.lit("+"), country, F.lit(" ("), area, F.lit(") "), three, F.lit("-"), four)),
        *[("phone", F.concat(F.lit("00"), country, pick("f1", " ", "-", "/", "."), area, pick("f2", " ", "-", ""), three, pick("f3", " ", "-", ""), four))] * 2,
        *[("phone", F.concat(F.lit("("), area, F.lit(")"), pick("f4", " ", "", "-"), three, pick("f5", "-", " ", "."), four))] * 2,
        *[("phone", join(pick("f6", "-", ".", " "), [area, three, four]))] * 2,
        ("phone", F.concat(F.lit("+"), country, F.lit("/"), area, F.lit("/"), three, four)),
        # look-alikes
        ("", F.concat(word("a"), pick("x1", " at ", " @ "), word("b"))),
        ("", F.concat(word("a"), F.lit(" at "), word("b"), pick("x2", ".", " dot "), word("c"))),
        ("", F.concat(word("a"), F.lit(" at "), small, F.lit("."), number(2, "n3"), F.lit(" "), word("b"))),
        ("", F.concat(F.lit("@"), word("a"), F.lit("."), word("b"))),
        ("", join(pick("x3", ".", "-", " . ", "[.]"), [F.concat(F.lit("9"), number(2, "q1")), octets[1], octets[2], octets[3]])),
        ("", join(pick("x4", ".", " . "), [*octets, number(2, "q5")])),
        ("", F.concat(F.lit("20"), small, F.lit("-"), pick("x5", "01", "07", "12"), F.lit("-"), pick("x6", "03", "18", "29"), F.lit(" "), pick("x7", "08", "21"), F.lit(":"), pick("x8", "00", "45"), F.lit(":"), number(2, "q9"))),
        ("", join("-", [pick("x9", "10", "25"), pick("xa", "02", "11"), F.concat(F.lit("20"), small), number(2, "qa")])),
        ("", wrong),
        ("", grouped(wrong, F.when(F.length(odd) > 1, F.lit(" ")).otherwise(odd))),
        ("", F.concat(pick("xb", "978", "979"), F.lit("-"), number(1, "qb"), F.lit("-"), number(4, "qc"), F.lit("-"), number(4, "qd"), F.lit("-"), number(1, "qe"))),
        ("", F.concat(number(1, "qf"), F.lit("."), number(14, "qg"))),
        ("", join(pick("xc", " ", ".", ","), [small, *(number(3, f"qh{i}") for i in range(3))])),
        ("", join(pick("xd", " ", ", ", "-"), [F.concat(F.lit("19"), number(2, "qi")), F.concat(F.lit("20"), number(2, "qj")), number(4, "qk")])),
        ("", F.concat(pick("xe", "no ", "id ", "#", "order "), number(10, "ql"))),
        ("", F.concat(F.lit("0."), number(10, "qm"))),
        ("", join("/", [number(4, "qn"), number(4, "qo"), number(3, "qp")])),
    ]


def training_rows(docs: DataFrame, size: int = DOCS) -> DataFrame:
    """doc_id, y and the features of the candidates in excerpts with an injected string each."""
    draw = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(draw, "doc_id").limit(size)
    text = common.text_of()
    at = F.pmod(draw, F.greatest(F.length(text) - 200, F.lit(1))) + 1
    rows = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", F.substring(text, at.cast("int"), F.lit(240)).alias("excerpt"))
    rows = common.stage(rows.groupBy("doc_id").agg(F.max("excerpt").alias("excerpt")), "pii-excerpts").repartition(16, "doc_id")
    rows = rows.withColumn("words", F.regexp_extract_all("excerpt", F.lit("[A-Za-z]{2,12}"), F.lit(0)))
    forms = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("string")) for k, v in _forms()))
    rows = rows.select("doc_id", "excerpt", F.posexplode(forms).alias("n", "f"))
    rows = rows.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(len(_forms()))) < FORMS_EACH)
    lead = F.element_at(F.array(*map(F.lit, ("", "", "", "", "tel: ", "mail: ", "call ", "12 ", "card ", "server ", "contact "))), (F.pmod(F.xxhash64("excerpt", "n"), F.lit(11)) + 1).cast("int"))
    trail = F.element_at(F.array(*map(F.lit, ("", "", "", "", "", " 12", ".", ", ", " 2024"))), (F.pmod(F.xxhash64("n", "excerpt"), F.lit(9)) + 1).cast("int"))
    left = F.concat(F.regexp_replace(F.substring("excerpt", 1, 120), r"\S*$", ""), lead)
    rows = rows.select("doc_id", F.col("f.kind").alias("want"), left.alias("left"), F.col("f.string").alias("string"), F.concat(trail, F.lit(" "), F.regexp_replace(F.substring("excerpt", 121, 120), r"^\S*\s?", "")).alias("right"))
    rows = rows.select("doc_id", "want", F.length("left").alias("since"), (F.length("left") + F.length("string")).alias("upto"), F.concat("left", "string", "right").alias("text"))
    found = candidates(common.stage(rows, "pii-injected"))  # else every pattern would build its text anew
    found = found.select("doc_id", "since", "upto", F.expr(f"array_position(array({', '.join(map(repr, KINDS))}), want) - 1").alias("want"), *(f"base_{k}" for k in KINDS), F.inline("candidates"))
    same = lambda s, e: (F.col("s") == s) & (F.col("e") == e)
    base = lambda k: (F.col("kind_no") == KINDS.index(k)) & F.exists(f"base_{k}", lambda b: same(b["s"], b["e"]))
    right = reduce(lambda a, b: a | b, (base(k) for k in KINDS), (F.col("kind_no") == F.col("want")) & same(F.col("since"), F.col("upto")))
    return found.withColumn("y", right.cast("double"))


def train(rows: DataFrame, size: int = SAMPLE) -> tuple[str, dict[str, float]] | None:
    """A SQL expression over a candidate `c` for the trees' sum, and the kinds' thresholds; None if rows are too few."""
    rows = rows.orderBy(F.xxhash64("doc_id", "s", "m"), "m", "s").limit(size)
    rows = common.stage(rows.select("y", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("aside"), *FEATURES), "pii-training")
    seen = {(r["y"], r["aside"]): r["count"] for r in rows.groupBy("y", "aside").count().collect()}
    if min(seen.get((y, a), 0) for y in (0, 1) for a in (True, False)) < 5:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="x")
    model = GBTClassifier(labelCol="y", featuresCol="x", maxIter=TREES, maxDepth=DEPTH, seed=1, cacheNodeIds=False).fit(vectors.transform(rows.filter(~F.col("aside"))))
    total = " + ".join(f"{w!r}D * ({_case(t.rootNode())})" for w, t in zip(model.treeWeights, model._java_obj.trees(), strict=True))
    scored = rows.filter("aside").select("y", "kind_no", F.expr(total.replace("c.", "")).alias("z"))
    scored = VectorAssembler(inputCols=["z"], outputCol="sum").transform(scored)
    least = {}
    for no, kind in enumerate(KINDS):
        curve = IsotonicRegression(featuresCol="sum", labelCol="y").fit(scored.filter(F.col("kind_no") == no))
        enough = [z for z, p in zip(curve.boundaries, curve.predictions, strict=True) if p >= PRECISION]
        if enough:
            least[kind] = float(min(enough))
    return total, least


def _case(node) -> str:
    """A tree's node as SQL."""
    if node.getClass().getSimpleName() == "LeafNode":
        return f"{float(node.prediction())!r}D"
    s = node.split()
    return f"CASE WHEN c.{FEATURES[s.featureIndex()]} <= {s.threshold()!r}D THEN {_case(node.leftChild())} ELSE {_case(node.rightChild())} END"


def detect(docs: DataFrame, model: tuple[str, dict[str, float]] | None = None) -> DataFrame:
    """docs with base_<kind> arrays and `spans`: kind, s, e of base and added spans, by kind, then start. The model is
    trained on docs if none is given."""
    model = model or train(training_rows(docs.select("doc_id", "text")))
    kinds = F.array(*map(F.lit, KINDS))
    named = lambda k: F.transform(f"base_{k}", lambda x: F.struct(F.lit(KINDS.index(k)).alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    out = (candidates(docs) if model else base_spans(docs)).withColumn("spans", F.concat(*(named(k) for k in KINDS)))
    if model:
        total, least = model
        limit = " ".join(f"WHEN {KINDS.index(k)} THEN {z!r}D" for k, z in least.items())
        limit = f"CASE c.kind_no {limit} ELSE double('inf') END" if least else "double('inf')"
        free = "filter(candidates, c -> NOT exists(spans, b -> b.s < c.e AND c.s < b.e))"
        scored = f"transform({free}, c -> struct({limit} - ({total}) AS short, int(c.kind_no) AS k, c.s AS s, c.e AS e))"
        best = f"array_sort(filter({scored}, c -> c.short <= 0))"
        clear = "aggregate(_added, cast(array() AS array<struct<k:int,s:int,e:int>>), (held, c) -> if(exists(held, b -> b.s < c.e AND c.s < b.e), held, array_append(held, struct(c.k AS k, c.s AS s, c.e AS e))))"
        out = out.withColumn("_added", F.expr(f"if(size(candidates) = 0, NULL, {best})"))
        out = out.withColumn("spans", F.expr(f"if(size(_added) > 0, array_sort(concat(spans, {clear})), spans)")).drop("_added")
    named_spans = F.transform("spans", lambda x: F.struct(F.element_at(kinds, x["k"] + 1).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return out.withColumn("spans", named_spans).drop("candidates")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans become one."""
    found = detect(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")))
    found = found.withColumn("_sorted", F.expr("array_sort(spans, (a, b) -> CASE WHEN a.s != b.s THEN a.s - b.s ELSE b.e - a.e END)"))
    step = "(z, x) -> IF(x.s < z.at, z, struct(x.e AS at, concat(z.text, substring(text, z.at + 1, x.s - z.at), '[', x.kind, ']') AS text))"
    text = F.expr(f"aggregate(_sorted, struct(0 AS at, '' AS text), {step}, z -> concat(z.text, substring(text, z.at + 1, length(text) - z.at)))")
    return found.withColumn("row", F.col("row").withField("text", text)).select("row.*")


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    named = lambda k: F.transform(f"base_{k}", lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    found = found.withColumn("base", reduce(F.concat, (named(k) for k in KINDS)))
    counts = (F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS)
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
