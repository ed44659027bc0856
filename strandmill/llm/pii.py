"""Personal data by fixed patterns and by bootstrapped context, in Spark's own expressions only.

Matches of four fixed patterns (email, ip, card, phone) are the base. Words that hold a digit
or an @ are instances; those that a base match reaches into are the seeds. An instance's
lexical patterns are the word to its left, the word to its right, and each of these with the
instance's shape (runs of letters and digits collapsed). A graph of patterns and instances is
scored in rounds: a pattern by the score of its instances, over all occurrences of its word in
the whole corpus, or, if it has a shape, over all instances beside that word that have it; an
instance by its patterns. Patterns of high confidence then mark the instances that no fixed
pattern knows, as kind ``context``. A pattern that common words make, like an article, stands
by other words far too often to be trusted.

A null text is empty. Repeated rows are searched each on its own. Offsets are code points, the
end exclusive. The fixed patterns are written without backtracking into groups, and a text is
taken apart once per pattern, so that a text of any length, with any number of matches, is
searched in about linear time and constant stack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm._common import GAP, WORD, cut, prepare

NAME = r"[A-Za-z0-9._%+-]"
#: Where the search for a run may start: after the match before, or where no run goes on.
_EMAIL = rf"(?:\G|(?<!{NAME})){NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"
#: What stands for each character of a base match where instances are told from seeds: a noncharacter.
_MARK = "\uFFFE"
_SPACE = r"\x20\x09-\x0D"
#: A word that holds a digit or an @ (or a mark).
_IDLIKE = rf"(?<![^{_SPACE}])(?=[^{_SPACE}]*[0-9@{_MARK}])[^{_SPACE}]++"
_LAST_WORD = rf"(?<![^{_SPACE}])([^{_SPACE}]++)[{_SPACE}]++$"
_FIRST_WORD = rf"^[{_SPACE}]++([^{_SPACE}]++)"
#: Accepted patterns that are looked up as a set; with more they are joined.
SET_ROWS = 10_000
#: Elements of an array that are summed up in one step.
_STEP = 64


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _upto(lo: Column, hi: Column) -> Column:
    """The numbers from ``lo`` to before ``hi``."""
    return F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))


def before_each(values: Column, zero: Column, join) -> Column:
    """For each element of an array what ``join`` makes of ``zero`` and all elements before it.

    By steps and by places, as a slice would copy the whole array."""
    fold = lambda xs, lo, hi, start: F.aggregate(_upto(lo, hi), start, lambda a, i: join(a, F.get(xs, i)))

    def whole(v: Column) -> Column:
        starts = F.transform(_upto(F.lit(0), F.ceil(F.size(v) / _STEP).cast("int")), lambda j: j * _STEP)
        sums = F.transform(starts, lambda a: fold(v, a, F.least(a + _STEP, F.size(v)), zero))
        ups = lambda s: F.transform(starts, lambda a, j: F.struct(a.alias("at"), fold(s, F.lit(0), j, zero).alias("up")))
        inside = lambda x: F.transform(_upto(x["at"], F.least(x["at"] + _STEP, F.size(v))), lambda i: fold(v, x["at"], i, x["up"]))
        return F.flatten(F.transform(let(sums, ups), inside))

    return let(values, whole)


def _cut_up(text: Column, pattern: str, guard: Column) -> Column:
    """struct(gaps, found): a pattern's matches and the texts before, between and after them."""
    none = F.struct(F.array(text).alias("gaps"), F.array().cast("array<string>").alias("found"))
    return F.when(guard, F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))).otherwise(none)


def _places(kind: Column, gaps: Column, found: Column) -> Column:
    """The matches with their places, which the texts between them give, and whether they are sound."""

    def spans(sizes: Column) -> Column:
        at = before_each(F.transform(sizes, lambda z: z["gap"] + z["own"]), F.lit(0), lambda a, x: a + x)
        span = lambda f, start, own: F.struct(start.alias("start"), (start + own).alias("end"), f.alias("found"), _sound(kind, f).alias("sound"))
        return let(at, lambda m: F.transform(found, lambda f, i: let(F.get(m, i) + F.get(sizes, i)["gap"], lambda start: span(f, start, F.get(sizes, i)["own"]))))

    return let(F.transform(found, lambda f, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(f).alias("own"))), spans)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Doubles every second digit from the right and sums digits."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def _sound(kind: Column, found: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    ip = F.forall(F.split(found, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.lpad(part(p), 3, "0") <= "255"))
    n = F.length(_digits(found))
    card = F.when((n >= 16) & (n <= 19), _luhn(_digits(found))).otherwise(F.lit(False))
    return F.when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", (n >= 8) & (n <= 15)).otherwise(F.lit(True))


def _matched(text: Column) -> Column:
    """array<struct<kind, gaps, spans>>: what each fixed pattern and, last, that of instances finds."""
    digit = text.rlike("[0-9]")
    asked = {"email": (_EMAIL, F.contains(text, F.lit("@"))), "ip": (_IP, digit), "card": (_CARD, digit), "phone": (_PHONE, F.contains(text, F.lit("+"))), CONTEXT: (_IDLIKE, text.rlike(f"[0-9@{_MARK}]"))}
    cuts = F.array(*(F.struct(F.lit(kind).alias("kind"), _cut_up(text, pattern, guard).alias("cut")) for kind, (pattern, guard) in asked.items()))
    return F.transform(cuts, lambda c: F.struct(c["kind"].alias("kind"), c["cut"]["gaps"].alias("gaps"), _places(c["kind"], c["cut"]["gaps"], c["cut"]["found"]).alias("spans")))


def _base(matched: Column) -> Column:
    sound = lambda c: F.transform(F.filter(c["spans"], lambda s: s["sound"]), lambda s: F.struct(c["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found")))
    return F.flatten(F.transform(F.filter(matched, lambda c: c["kind"] != CONTEXT), sound))


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, found>> by kind, then start."""
    return _base(_matched(text))


def _hidden(matched: Column) -> Column:
    """For each fixed pattern with sound matches: which of the text's instances it reaches into.

    Each character of a match but spaces is marked, so that instances stay the same words."""
    hide = lambda g, s: F.concat(g, F.coalesce(F.when(s["sound"], F.regexp_replace(s["found"], "[^ ]", _MARK)).otherwise(s["found"]), F.lit("")))
    words = lambda c: F.regexp_extract_all(F.array_join(F.zip_with(c["gaps"], c["spans"], hide), ""), F.lit(_IDLIKE), F.lit(0))
    some = F.filter(matched, lambda c: (c["kind"] != CONTEXT) & F.exists(c["spans"], lambda s: s["sound"]))
    return F.transform(some, lambda c: F.transform(words(c), lambda w: F.contains(w, F.lit(_MARK))))


def _normal(word: Column) -> Column:
    """In lower case and without punctuation at its ends."""
    return F.regexp_replace(F.lower(word), r"^[\p{Punct}]++|(?<![\p{Punct}])[\p{Punct}]++$", "")


def _shape(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, r"[\p{L}\p{M}]++", "a"), "[0-9]++", "9")


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` (spans) and ``seeds`` and ``others``: the words that hold a digit or an @ and are in a base span, and the rest of them, each with left, right and shape."""
    named = docs.withColumn("__matched", _matched(F.coalesce(F.col(text_col), F.lit(""))))
    last = F.element_at("__matched", -1)
    beside = F.transform(last["gaps"], lambda g: F.struct(F.regexp_extract(g, _LAST_WORD, 1).alias("last"), F.regexp_extract(g, _FIRST_WORD, 1).alias("first")))
    places = last["spans"]
    named = named.withColumns({"base": _base(F.col("__matched")), "__hidden": _hidden(F.col("__matched")), "__places": places, "__gaps": F.when(F.size(places) > 0, beside)}).drop("__matched")
    seeds = F.transform("__places", lambda p, i: F.exists("__hidden", lambda h: F.coalesce(F.get(h, i), F.lit(False))))
    named = named.withColumn("__seeds", seeds).drop("__hidden")

    def side(word: Column, i: Column, j: Column) -> Column:
        # inside a seed of several words nothing stands beside it
        other = F.when(F.get("__seeds", i) & F.coalesce(F.get("__seeds", j), F.lit(False)), "").otherwise(F.coalesce(F.get("__places", j)["found"], F.lit("")))
        return _normal(F.when(word != "", word).otherwise(other))

    def instance(p: Column, i: Column) -> Column:
        left, right = side(F.get("__gaps", i)["last"], i, i - 1), side(F.get("__gaps", i + 1)["first"], i, i + 1)
        return F.struct(F.lit(CONTEXT).alias("kind"), p["start"].alias("start"), p["end"].alias("end"), p["found"].alias("found"), left.alias("left"), right.alias("right"), _shape(p["found"]).alias("shape"), F.get("__seeds", i).alias("seed"))

    out = named.withColumn("__all", F.transform("__places", instance)).drop("__places", "__gaps", "__seeds")
    return out.withColumns({"seeds": F.filter("__all", lambda x: x["seed"]), "others": F.filter("__all", lambda x: ~x["seed"])}).drop("__all")


def patterns(instance: Column) -> Column:
    """An instance's lexical patterns: side, word and shape, if any."""
    one = lambda side, shape: F.when(instance[side] != "", F.struct(F.lit(side).alias("side"), instance[side].alias("word"), shape.alias("shape")))
    each = [one(side, shape) for side in ("left", "right") for shape in (F.lit(""), instance["shape"])]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


PATTERN = ["side", "word", "shape"]


def accepted_patterns(docs: DataFrame, scanned: DataFrame, text_col: str = "text", support: int = 5, confidence: float = 0.8, rounds: int = 3) -> DataFrame:
    """(side, word, shape, conf): the patterns that are trusted, over all occurrences in ``docs``."""
    instances = scanned.select(F.explode(F.concat("seeds", "others")).alias("s")).select("s.found", F.col("s.seed").cast("double").alias("seed"), F.explode(patterns(F.col("s"))).alias("p")).select("found", "seed", "p.*")
    edges = cut(instances.groupBy(*PATTERN, "found").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")))
    # a pattern needs so many different seeds, at first or through others found on the way
    supported = cut(edges.groupBy(*PATTERN).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("beside")).where(F.col("k") >= support).drop("k"))
    asked = supported.where("shape = ''").select("word").distinct()
    asked = F.broadcast(asked) if asked.count() <= SET_ROWS else asked
    words = docs.select(F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), GAP)).alias("w")).select(_normal(F.col("w")).alias("word")).where("word <> ''")
    totals = words.join(asked, "word").groupBy("word").agg(F.count(F.lit(1)).alias("all"))
    known = supported.join(totals, "word", "left").select(*PATTERN, F.when(F.col("shape") == "", F.greatest("all", "beside")).otherwise(F.col("beside")).alias("total"))
    graph = cut(edges.join(known, PATTERN))
    found = graph.groupBy("found").agg(F.max("seed").alias("score"))
    for _ in range(rounds):
        conf = graph.join(found, "found").groupBy(*PATTERN).agg((F.sum(F.col("n") * F.col("score")) / F.max("total")).alias("conf"), F.count_if(F.col("score") > 0).alias("k"))
        conf = cut(conf.where(F.col("k") >= support).select(*PATTERN, F.least("conf", F.lit(1.0)).alias("conf")))
        up = graph.join(conf, PATTERN).groupBy("found").agg(F.max("seed").alias("seed"), (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-9)))))).alias("any"))
        found = cut(up.select("found", F.greatest("seed", "any").alias("score")))
    return conf.where(F.col("conf") >= confidence)


def _with_context(scanned: DataFrame, accepted: DataFrame) -> DataFrame:
    """``scanned`` with ``context``: the others that an accepted pattern marks."""
    key = lambda p: F.concat_ws("\n", p["side"], p["word"], p["shape"])
    none = F.slice("others", 1, 0)
    if accepted.count() <= SET_ROWS:
        names = [r[0] for r in accepted.select(key(F.struct(*PATTERN))).collect()]  # so many at most
        return scanned.withColumn("context", F.filter("others", lambda s: F.exists(patterns(s), lambda p: key(p).isin(names))) if names else none)
    rows = cut(scanned.withColumn("__row", F.monotonically_increasing_id()))
    each = rows.select("__row", F.explode("others").alias("s")).select("__row", "s", F.explode(patterns(F.col("s"))).alias("p")).select("__row", "s", "p.*")
    per = each.join(accepted.select(*PATTERN), PATTERN).groupBy("__row").agg(F.array_sort(F.collect_set("s")).alias("context"))
    return rows.join(per, "__row", "left").withColumn("context", F.coalesce("context", none)).drop("__row")


def _plain(spans: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found")))


def find(docs: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with ``base`` and ``context`` spans in place of the text and of columns of these names."""
    prepare(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text_col, "base", "context")]
    packed = docs.select(F.struct(F.lit(0), *(F.col(f"`{c}`") for c in rest)).alias("__doc"), F.col(f"`{text_col}`").alias("__text"))
    scanned = cut(scan(packed, "__text").drop("__text"))
    found = _with_context(scanned, accepted_patterns(packed, scanned, "__text", **settings))
    return found.select(*(F.col("__doc").getField(c).alias(c) for c in rest), "base", _plain("context").alias("context"))


def redact(docs: DataFrame, text_col: str = "text", n_chars_col: str = "n_chars", **settings) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; overlapping spans by the first one's."""
    prepare(docs.sparkSession)
    learnt = cut(scan(docs.select(text_col), text_col).drop(text_col))
    accepted = cut(accepted_patterns(docs, learnt, text_col, **settings))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), F.col(text_col).alias("__text"))
    found = _with_context(scan(packed, "__text"), accepted)
    ordered = F.array_sort(F.transform(F.concat(_plain("base"), _plain("context")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    out = found.withColumn("__spans", ordered).drop("base", "context", "seeds", "others")
    # how far the spans before each reach: one that starts in between is dropped
    out = out.withColumn("__reach", before_each(F.transform("__spans", lambda s: s["end"]), F.lit(0), lambda a, x: F.greatest(a, x)))
    # bound once: a column that is read by place in a lambda would be evaluated for each span
    placed = let(F.col("__reach"), lambda reach: F.transform("__spans", lambda s, i: F.struct(F.get(reach, i).alias("from"), s["start"].alias("start"), s["kind"].alias("kind"))))
    kept = F.filter(placed, lambda s: s["start"] >= s["from"])
    out = out.withColumns({"__kept": kept, "__end": F.coalesce(F.array_max(F.transform("__spans", lambda s: s["end"])), F.lit(0))})
    named = lambda s: F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
    t = F.col("__text")
    by_place = F.concat(F.array_join(F.transform("__kept", lambda s: F.concat(F.substring(t, s["from"] + 1, s["start"] - s["from"]), named(s))), ""), F.substring(t, F.col("__end") + 1, F.length(t)))
    # with many spans the characters are laid out once
    letters = lambda c, lo, hi: F.array_join(F.transform(_upto(lo, hi), lambda i: F.get(c, i)), "")
    by_letter = let(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.concat(F.array_join(F.transform("__kept", lambda s: F.concat(letters(c, s["from"], s["start"]), named(s))), ""), letters(c, F.col("__end"), F.size(c))))
    n = F.size("__spans")
    out = out.withColumn("__text", F.when(n == 0, t).when(n <= _STEP, by_place).otherwise(by_letter))
    new = {text_col: F.col("__text")} | ({n_chars_col: F.length("__text").cast(docs.schema[n_chars_col].dataType)} if n_chars_col in docs.columns else {})
    return out.select(*((new[c] if c in new else F.col("__doc").getField(c)).alias(c) for c in docs.columns))
