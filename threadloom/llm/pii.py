"""Personal data: fixed kinds by pattern, and more of them by bootstrapped contexts.

The fixed kinds seed a graph of patterns and instances. Instances are what may fill a slot: spans of
the fixed kinds, grouped digits, identifier-like words. The patterns of a slot are the two words left
of it, the one word left, the one word right (fewer at a text's ends) and the filler's shape, in which
a letter stands for any run of letters and a digit for any digit, or for any run of them. A pattern's score for a kind is the share of
its different instances held to be of that kind; patterns with enough support and a high score pass
their score on to their other instances, and scoring repeats. What stands in a slot with a pattern
that ends with a high score is reported as of the kind of its best one. Everything is built-in
expressions, joins and aggregates; texts are scanned once and only spans leave the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import text_key
from threadloom.storage import materialize

KINDS = ("email", "ip", "card", "phone")
# The patterns match at the same places as their plain forms, but can't backtrack over long runs:
# a run is entered at its start only (or where the last match ended), and taken whole.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BYTE_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
# What may fill a slot, the first that fits: the words that hold a phone or card (as above, with so
# many digits as these have), a run of groups of digits (19 at most, as in the longest card), or one
# word with a digit, an @ or a low line in it.
_PHONE_DIGITS = r"(?=\+(?:[ ().-]*+[0-9]){9,15}+(?![ ().-]*+[0-9]))\+(?:[ ().-]*+[0-9])++"
_CARD_DIGITS = r"(?<![0-9])(?<![0-9][ -])(?=(?:[0-9][ -]?+){12,19}+(?![0-9]))[0-9](?:[ -]?+[0-9])++"
_GROUP = r"[+(]*+[0-9][0-9().-]*+(?![^\s,;:!?\]])"
_AT_MOST_19 = r"(?!(?:[+(]*+[0-9][().-]*+(?:(?<=[0-9)]) )?+){20})"
_MARKS = r"[(\[\"'<.,;:!?)\]>]"
# The next word after what is attached to a slot, less marks that stand alone.
_RIGHT = rf"^\S*+\s++(?:{_MARKS}++\s++)*+(?!{_MARKS}++$)(\S++)"
SLOT = (rf"(?<!\S)(?:(?:\S*?(?:{_PHONE_DIGITS}|{_CARD_DIGITS}))++\S*+"
        rf"|(?<![0-9)] ){_AT_MOST_19}{_GROUP}(?:(?<=[0-9)]) {_GROUP})++"
        r"|[^\s0-9@_]*+[0-9@_]\S*+)")
BLOCK = 64


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where the body uses it in lambdas."""
    return F.transform(F.array(value), body)[0]


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def matches(text: Column, pattern: str, keep=None) -> Column:
    """Non-overlapping matches as array of (start, end, text, gap, after): code points, end exclusive,
    the text between the last match and this one, and up to the next. ``keep`` says of a match's text
    whether it stays.

    A start is the sum of all lengths before it; sums of blocks, and of blocks of blocks, keep that
    from being quadratic.
    """
    def sums(numbers):
        last = F.floor((F.size(numbers) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(numbers, b * BLOCK + 1, F.lit(BLOCK))))

    def place(m, i, gaps, steps, blocks, wide):
        block = F.floor(i / BLOCK).cast("int")
        whole = F.floor(i / BLOCK ** 2).cast("int")
        start = (total(F.slice(wide, F.lit(1), whole)) + total(F.slice(blocks, whole * BLOCK + 1, block - whole * BLOCK))
                 + total(F.slice(steps, block * BLOCK + 1, i - block * BLOCK + 1)))
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("text"), gaps[i].alias("gap"),
                        gaps[i + 1].alias("after"))

    def placed(found, gaps):
        steps = F.transform(found, lambda m, i: F.length(gaps[i]) + F.when(i > 0, F.length(found[i - 1])).otherwise(0))
        kept = F.filter(F.transform(found, lambda m, i: F.struct(m.alias("m"), i.alias("i"))),
                        (lambda x: keep(x["m"])) if keep else (lambda x: F.lit(True)))
        return let(steps, lambda s: let(sums(s), lambda blocks: let(sums(blocks), lambda wide: F.transform(
            kept, lambda x: place(x["m"], x["i"], gaps, s, blocks, wide)))))

    none = F.expr("cast(array() as array<struct<start:int,end:int,text:string,gap:string,after:string>>)")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(
        F.size(found) > 0, let(F.split(text, pattern, -1), lambda gaps: placed(found, gaps))).otherwise(none))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def value(i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def base_spans(text: Column) -> Column:
    """Array of (start, k, end) of the fixed kinds, sorted; k is the place in ``KINDS``."""
    found = [
        matches(text, EMAIL),
        matches(text, IP, lambda m: m.rlike(BYTE_PARTS)),
        matches(text, CARD, lambda m: F.length(_digits(m)).between(12, 19) & luhn(_digits(m))),
        matches(text, PHONE, lambda m: F.length(_digits(m)).between(9, 15)),
    ]
    needs = [text.contains("@"), text.rlike(r"[0-9]\.[0-9]"), text.rlike("[0-9][ -]?[0-9]"), text.contains("+")]
    none = F.expr("cast(array() as array<struct<start:int,k:int,end:int>>)")

    def spans(k: int) -> Column:
        span = lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"))
        return F.when(needs[k], F.transform(found[k], span)).otherwise(none)

    return F.array_sort(F.concat(*map(spans, range(len(KINDS)))))


def _words(text: Column) -> Column:
    """Words of a text between slots, lower-cased, less what only opens or ends something."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"\S+"), F.lit(0)), lambda w: ~w.rlike(rf"^{_MARKS}++$"))


def _form(token: Column) -> Column:
    """What stands for another slot among the words around a slot."""
    return F.when(token.contains("@"), "@").when(token.rlike("[0-9]"), "0").otherwise("_")


def _shape(token: Column, digits: str) -> Column:
    return F.regexp_replace(F.regexp_replace(token, r"\p{L}++", "a"), digits, "0")


def _last_two(words: Column) -> Column:
    return F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2))


def _left_words(i: Column, forms: Column, gaps: Column, first: Column) -> Column:
    """The last two of the words before slot ``i``: those in the gap before it, the form of the slot
    before, the gap before that, and so on; ``first`` stands before the first gap."""
    none = F.expr("cast(array() as array<string>)")
    at = lambda values, j: F.when(j >= 0, F.get(values, j)).otherwise(none)
    form = lambda j: F.when(j >= 0, F.array(F.get(forms, j))).otherwise(none)
    opening = F.when(i <= 1, first).otherwise(none)
    return _last_two(F.concat(opening, form(i - 2), at(gaps, i - 1), form(i - 1), F.get(gaps, i)))


def _patterns(left: Column, right: Column, token: Column) -> Column:
    n = F.size(left)
    return F.array_compact(F.array(F.concat(F.lit("left2 "), F.array_join(left, " ")),
                                   F.when(n > 0, F.concat(F.lit("left1 "), F.get(left, n - 1))),
                                   F.concat(F.lit("right "), right), F.concat(F.lit("shape "), _shape(token, "[0-9]")),
                                   F.concat(F.lit("runs "), _shape(token, "[0-9]++"))))


def _instance(token: Column) -> Column:
    """Grouped digits are the same instance however they are grouped."""
    return F.when(token.rlike(r"^[+(]*+[0-9][0-9 ().-]*+$") & ~token.rlike(r"\..*\."), _digits(token)).otherwise(token)


def slots(text: Column) -> Column:
    """Array of (start, end, token, patterns, seed): what looks like an identifier, and its patterns,
    with slots next to it by their form.

    Where a slot holds spans of the fixed kinds each gives a row with its kind as ``seed``. Else
    ``seed`` is null, and the slot goes without end punctuation.
    """
    def seeded(x, own):
        """Rows of the spans ``own`` of slot ``x``. The slot is taken apart into characters once, as
        each place in a string is found by counting from its start."""
        def row(s, i, raw, gaps, forms):
            right = F.when(i < F.size(own) - 1, F.get(forms, i + 1)).otherwise(x["right"])
            return F.struct((x["start"] + s["start"]).alias("start"), (x["start"] + s["end"]).alias("end"),
                            F.when(s["k"] >= 2, _digits(raw[i])).otherwise(raw[i]).alias("token"),
                            _patterns(_left_words(i, forms, gaps, x["left"]), right, raw[i]).alias("patterns"), s["k"].alias("seed"))

        def rows_of(chars):
            cut = lambda a, b: F.array_join(F.slice(chars, a + 1, F.greatest(b - a, F.lit(0))), "")
            gap = lambda s, i: F.transform(
                _words(cut(F.when(i > 0, F.get(own, i - 1)["end"]).otherwise(0), s["start"])),
                lambda w: F.when(w.rlike("[0-9@_]"), _form(w)).otherwise(w))
            return let(F.transform(own, lambda s: cut(s["start"], s["end"])), lambda raw: let(
                F.transform(own, gap), lambda gaps: let(F.transform(raw, _form), lambda forms: F.transform(
                    own, lambda s, i: row(s, i, raw, gaps, forms)))))

        return let(F.regexp_extract_all(x["text"], F.lit("(?s)."), F.lit(0)), rows_of)

    def alone(x):
        return let(F.regexp_replace(x["text"], r"(?<![.,;:!?)\]])[.,;:!?)\]]++$", ""), lambda t: F.array(F.struct(
            x["start"].alias("start"), (x["start"] + F.length(t)).alias("end"), _instance(t).alias("token"),
            _patterns(x["left"], x["right"], t).alias("patterns"), F.lit(None).cast("int").alias("seed"))))

    def rows(x):
        # A card within a phone is no seed of its own.
        outer = lambda spans: F.filter(spans, lambda s, i: (i == 0) | (F.get(spans, i - 1)["end"] <= s["start"]))
        return let(base_spans(x["text"]), lambda spans: F.when(F.size(spans) == 0, alone(x)).otherwise(
            let(outer(spans), lambda own: seeded(x, own))))

    def with_context(found):
        # What is attached to the slot before is no word of its own.
        gaps = F.transform(found, lambda x, i: _last_two(_words(F.when(i > 0, F.regexp_replace(x["gap"], r"^\S++", "")).otherwise(x["gap"]))))
        forms = F.transform(found, lambda x: _form(x["text"]))
        none = F.expr("cast(array() as array<string>)")

        def right(x, i, f):
            word = F.lower(F.regexp_extract(x["after"], _RIGHT, 1))
            return F.when(word != "", word).otherwise(F.coalesce(F.get(f, i + 1), F.lit("")))

        return let(gaps, lambda g: let(forms, lambda f: F.transform(found, lambda x, i: F.struct(
            x["start"].alias("start"), x["text"].alias("text"), _left_words(i, f, g, none).alias("left"), right(x, i, f).alias("right")))))

    none = F.expr("cast(array() as array<struct<start:int,end:int,token:string,patterns:array<string>,seed:int>>)")
    return F.when(text.rlike("[0-9@_]"), F.flatten(F.transform(let(matches(text, SLOT), with_context), rows))).otherwise(none)


def confident_patterns(scan: DataFrame, rounds: int, min_support: int, min_score: float) -> DataFrame:
    """(pattern, k, score) of the patterns that end with a high score. ``scan`` has key and slots."""
    edges = scan.select(F.explode("slots").alias("s")).select(F.explode("s.patterns").alias("pattern"), "s.token", "s.seed")
    edges = materialize(edges.groupBy("pattern", "token").agg(F.min("seed").alias("seed")), "pii-graph")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    held = edges.filter("seed is not null").select("token", F.col("seed").alias("k"), F.lit(1.0).alias("weight")).distinct()
    patterns = None
    for _ in range(rounds):
        scores = (edges.select("pattern", "token").join(held, "token").groupBy("pattern", "k")
                  .agg(F.sum("weight").alias("w"), F.count("*").alias("support")).join(sizes, "pattern")
                  .select("pattern", "k", F.round(F.col("w") / F.col("n"), 9).alias("score"), "support"))
        patterns = materialize(scores.filter((F.col("support") >= min_support) & (F.col("score") >= min_score)), "pii-patterns")
        # Noisy or of the patterns an instance fills; what matches a fixed kind keeps that kind.
        learned = (edges.filter("seed is null").join(patterns, "pattern").groupBy("token", "k")
                   .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("weight")))
        held = materialize(edges.filter("seed is not null").select("token", F.col("seed").alias("k"), F.lit(1.0).alias("weight"))
                           .distinct().unionByName(learned), "pii-instances")
    best = F.max_by(F.struct("k", "score"), F.struct("score", -F.col("k")))
    return patterns.groupBy("pattern").agg(best.alias("b")).select("pattern", "b.k", "b.score")


def _overlaps(a: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"]))


def discovered_spans(scan: DataFrame, patterns: DataFrame) -> DataFrame:
    """(key, more): spans (start, k, end) found by context alone, for each different text."""
    rows = (scan.select("key", F.explode("slots").alias("s")).filter("s.seed is null")
            .select("key", "s.start", "s.end", F.explode("s.patterns").alias("pattern")))
    best = F.max_by("k", F.struct("score", -F.col("k")))
    return (rows.join(patterns, "pattern").groupBy("key", "start", "end").agg(best.alias("k"))
            .groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "k", "end"))).alias("more")))


def find_spans(docs: DataFrame, rounds: int = 2, min_support: int = 5, min_score: float = 0.7,
               id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, key, base, spans) of every row: arrays of (start, k, end), sorted.

    ``base`` has the fixed kinds; ``spans`` has these and what contexts add, which never overlaps
    them. Null texts count as empty and have neither. Ids and repeated rows stay as they are; equal
    texts get equal spans. Other columns are not read.
    """
    scan = materialize(scanned(docs, id_col, text_col, keep), "pii-scan")
    # Written, so that the join shuffles both sides for itself and Spark may split a hot text.
    more = materialize(discovered_spans(scan, confident_patterns(scan, rounds, min_support, min_score)), "pii-more")
    return with_more(scan.drop("slots"), more)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(id_col, *keep, text_key(text).alias("key"), base_spans(text).alias("base"), slots(text).alias("slots"))


def with_more(rows: DataFrame, more: DataFrame) -> DataFrame:
    new = F.filter("more", lambda a: ~_overlaps(a, F.col("base")))
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", new)))
    return rows.join(more, "key", "left").withColumn("spans", spans).drop("more")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["k"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["k"] == KINDS.index(kind))).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each run of overlapping spans replaced by the kind of its first in brackets."""
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, s):
        inside = s["start"] < a["at"]
        out = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), kinds[s["k"]])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(inside, a["out"]).otherwise(out).alias("out"))

    whole = F.aggregate(spans, empty, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
