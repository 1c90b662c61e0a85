"""Secret scan in DataFrame operations only: three fixed patterns, and two character Markov models for what they miss.

A run of token characters outside the fixed patterns counts as a secret when its log-likelihood under a bigram model of random
strings exceeds that under a model of ordinary identifiers by ``min_bits`` and by BITS_EACH for each character. Both models are
counted by Spark from labelled samples: random strings are made by hash functions and taken from the fixed patterns' hits, ordinary
ones are the words of a bounded sample of documents and names as programs write them. The driver gets the two tables of bigram counts (at most 2 x 95 x 95 rows).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actlake.llm.common import fresh

# The patterns that results are compared by, and the least length of what they find.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "markov")

#: A run that cannot grow within its class matches with its least length exactly when the unbounded run is long enough.
_LONG = {"access": ACCESS.replace("+", f"{{{MIN_ACCESS - 4},}}"), "hex": HEX.replace("+", f"{{{MIN_HEX},}}")}
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
MIN_BITS = 16.0
#: Bits that a secret has for each of its characters; set on samples that no model has seen (README: error rates).
BITS_EACH = 1.5
SAMPLE_DOCUMENTS = 3000
_WIDTH = 95
MASK = "[SECRET]"
#: Beyond every place of a text, and the code points that a text is cut into to be masked.
_FAR, _BLOCK = 2**31 - 1, 1024
_MOST, _LEAST = (lambda a, b: F.greatest(a, b)), (lambda a, b: F.least(a, b))
SPAN = "array<struct<start:int,rank:int,end:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, op: Callable[[Column, Column], Column], neutral: int) -> Column:
    """``op`` over each element and all before it, in as many passes as the array's length has bits."""

    def passes(v: Column, n: Column) -> Column:
        def once(done: Column, k: Column) -> Column:
            step = F.pow(F.lit(2), k).cast("int")
            before = lambda x: F.concat(F.array_repeat(F.lit(neutral), x), F.slice(done, F.lit(1), n - x))
            return F.when(step < n, F.zip_with(done, before(step), op)).otherwise(done)

        return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)))).cast("int")), v, once)

    return _let(values, lambda v: passes(v, F.size(v)))


def _hits(text: Column, pattern: str, rank: int, keep=lambda hit: F.lit(True)) -> Column:
    """Leftmost non-overlapping matches that ``keep`` holds for, as (start, rank, end) in code points, end exclusive.

    The pieces between the matches give the positions: a match ends where the pieces and matches up to it end.
    """

    def spans(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        ends = _running(F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.length(h)), lambda a, b: a + b, 0)
        named = F.zip_with(hits, ends, lambda h, e: F.struct((e - F.length(h)).alias("start"), F.lit(rank).alias("rank"), e.alias("end"), h.alias("hit")))
        return F.transform(F.filter(named, lambda s: keep(s["hit"])), lambda s: F.struct(s["start"], s["rank"], s["end"])).cast(SPAN)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(found, lambda hits: F.when(F.size(hits) > 0, spans(hits)).otherwise(F.array().cast(SPAN)))


def base_spans(text: Column) -> Column:
    """Sorted spans of the three fixed patterns; of equal starts the kind listed first comes first."""
    return F.array_sort(
        F.concat(
            _hits(text, ASSIGN, 0, lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= MIN_ASSIGN),
            _hits(text, _LONG["access"], 1),
            _hits(text, _LONG["hex"], 2),
        )
    )


def _bigrams(samples: DataFrame) -> DataFrame:
    """(kind, a, b, n): how often code b follows code a in the samples of each kind."""
    pairs = samples.select("kind", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, F.lit(2)))).alias("ab"))
    return pairs.groupBy("kind", F.ascii("ab").alias("a"), F.ascii(F.substring("ab", 2, 1)).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def generated(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Random strings in the alphabets that keys are written in: hex digits, base 64, capitals with digits."""
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    raw = F.base64(F.unhex(digest))
    s = F.when(F.col("id") % 3 == 0, F.left(digest, F.lit(40))).when(F.col("id") % 3 == 1, raw).otherwise(F.upper(F.regexp_replace(raw, "[+/=]", "")))
    return spark.range(n).select(F.lit("random").alias("kind"), s.alias("s"))


# Words that names in programs are made of.
NAME_WORDS = """account action active add admin agent alert all api app array async auth backup base batch binary body buffer build button byte cache call
cancel certificate channel check class client close cloud code collection column command commit common config connection container content context controller
copy core count create credential current custom data database date debug decode default delete deploy description device dialog directory document domain
download driver dynamic edit element email enable encode endpoint entity entry environment error event example exception execute export factory false field file
filter final find first flag folder format frame function gateway generate get global graph group handler hash header height helper history host http icon image
impl import index info init input instance integer interface internal invalid item java job json jquery keyboard label language layout length level library limit
link list listener load local location lock log login manager map master max memory menu message method metric migrate min mode model module monitor mutex name
network next node notification null number object offset open operator option order org output owner package page panel parent parse password path payload
permission platform plugin pointer policy pool port prefix process product profile project property protocol provider proxy public query queue random range
read record redirect refresh region register release remote remove render report repository request require reset resource response result retry return role root
route row rule runtime sample save schedule schema scope script search section select send sequence serializer server service session set setting shape signature
size socket sort source spec stack start state static status step storage store stream string style submit subscription success switch sync system table tag target
task template test text thread time timeout title token tool topic total trace transaction transform tree trigger type unique update upload url user utility uuid
valid value variable vector version view visible wait warning weight widget window worker wrapper write xml yaml zone"""
#: Words that one name is made of, at most.
_NAME = 5


def names(words: DataFrame) -> DataFrame:
    """Ordinary names made of the words (arrays ``w``, up to five each) in the ways that programs write them, one for each way."""
    w = F.filter("w", lambda x: x.rlike("^[A-Za-z]{2,}$"))
    low = F.transform(w, lambda x: F.lower(x))
    camel = F.array_join(F.transform(low, lambda x: F.initcap(x)), "")
    lead = F.concat(F.get(low, F.lit(0)), F.array_join(F.transform(F.slice(low, 2, _NAME), lambda x: F.initcap(x)), ""))
    digest = F.md5(F.array_join("w", " "))
    groups = F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    made = [
        camel, lead, F.array_join(low, "_"), F.array_join(low, "-"), F.upper(F.array_join(low, "_")), F.concat(F.array_join(F.slice(low, 1, 3), "/"), F.lit("/"), camel),
        F.concat(camel, F.pmod(F.hash("w"), F.lit(100)).cast("string")), groups,
    ]
    return words.where(F.size(w) > 1).select(F.lit("ordinary").alias("kind"), F.explode(F.array(*made)).alias("s"))


def named(spark: SparkSession, n: int = 4000) -> DataFrame:
    """``names`` made of NAME_WORDS, picked by hashes, and runs of one character."""
    words = F.split(F.lit(" ".join(NAME_WORDS.split())), " ")
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(NAME_WORDS.split()))) + 1).cast("int"))
    made = names(spark.range(n).select(F.slice(F.array(*map(pick, range(_NAME))), F.lit(1), (F.col("id") % 3 + 3).cast("int")).alias("w")))
    runs = spark.range(n).select(F.lit("ordinary").alias("kind"), F.repeat(F.char(F.col("id") % 94 + 33), F.lit(24)).alias("s"))
    return made.unionByName(runs)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_documents: int = SAMPLE_DOCUMENTS) -> list[float]:
    """Log-likelihood ratios in bits, random over ordinary, at place (a - 32) * 95 + b - 32 for codes a, b.

    The ordinary sample holds the words of ``sample_documents`` documents, those with the smallest hash of the id, names in the ways of
    programs made of these words, and names made of a fixed list of words; words in which a fixed pattern finds something count as random.
    """
    ids = docs.select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample_documents)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(ids), "_id")
    words = texts.select(F.explode(F.regexp_extract_all(F.coalesce("_text", F.lit("")), F.lit(r"[!-~]{8,}"), F.lit(0))).alias("s"))
    # a key may follow "name=": the value alone is what the random model learns
    value = F.regexp_extract("s", r"([A-Za-z0-9+/_-]{16,}=*)$", 1)
    secret = F.col("s").rlike(_LONG["access"]) | F.col("s").rlike(_LONG["hex"]) | (F.col("s").rlike(ASSIGN) & (F.length(value) > 0))
    seen = words.select(F.when(secret, "random").otherwise("ordinary").alias("kind"), F.when(secret, value).otherwise(F.col("s")).alias("s"))
    own = F.split(F.coalesce("_text", F.lit("")), r"[^A-Za-z]+")
    fives = F.transform(F.sequence(F.lit(0), F.greatest(F.size(own) - 1, F.lit(0)), F.lit(20 * _NAME)), lambda i: F.slice(own, i + 1, F.lit(_NAME)))
    made = names(texts.select(F.explode(fives).alias("w")))
    samples = seen.unionByName(generated(docs.sparkSession)).unionByName(made).unionByName(named(docs.sparkSession)).where(F.length("s") > 1)
    counts = {k: [0.5] * (_WIDTH * _WIDTH) for k in ("random", "ordinary")}
    for r in _bigrams(samples).where((F.col("a").between(32, 126)) & (F.col("b").between(32, 126))).collect():
        counts[r.kind][(r.a - 32) * _WIDTH + r.b - 32] += r.n
    logs = {}
    for k, table in counts.items():
        rows = [table[i : i + _WIDTH] for i in range(0, len(table), _WIDTH)]
        logs[k] = [math.log2(x / sum(row)) for row in rows for x in row]
    return [round(a - b, 4) for a, b in zip(logs["random"], logs["ordinary"], strict=True)]


def ratio(hit: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string of printable ASCII, in bits."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")  # folded into one literal
    codes = F.transform(F.split(hit, ""), lambda c: F.ascii(c) - 32)
    places = _let(codes, lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: a * _WIDTH + b + 1))
    return F.aggregate(places, F.lit(0.0), lambda total, k: total + F.element_at(table, k))


def added_spans(text: Column, base: Column, model: list[float], min_bits: float = MIN_BITS) -> Column:
    """Spans that only the Markov models find: candidates clear of all base spans whose ratio reaches ``min_bits`` and BITS_EACH a character."""

    def clear(spans: Column) -> Column:
        # a base span that starts no later reaches into a span if it ends within it; one that starts later if it starts within it
        is_base = lambda s: s["rank"] < len(KINDS) - 1
        ends = _running(F.transform(spans, lambda s: F.when(is_base(s), s["end"]).otherwise(0)), _MOST, 0)
        starts = F.transform(F.reverse(spans), lambda s: F.when(is_base(s), s["start"]).otherwise(_FAR))
        next_start = F.reverse(_running(starts, _LEAST, _FAR))
        free = F.zip_with(spans, F.arrays_zip(ends.alias("end"), next_start.alias("start")), lambda s, near: F.struct(s.alias("s"), ((near["end"] <= s["start"]) & (near["start"] >= s["end"])).alias("free")))
        return F.transform(F.filter(free, lambda x: x["free"] & ~is_base(x["s"])), lambda x: x["s"])

    found = _hits(text, CANDIDATE, len(KINDS) - 1, lambda hit: ratio(hit, model) >= F.greatest(F.lit(min_bits), BITS_EACH * F.length(hit)))
    return _let(found, lambda new: F.when((F.size(new) > 0) & (F.size(base) > 0), _let(F.array_sort(F.concat(base, new)), clear)).otherwise(new))


def find(docs: DataFrame, model: list[float], text_col: str = "text", base_col: str = "_base", all_col: str = "_spans") -> DataFrame:
    """``docs`` with two arrays of (start, rank, end): the fixed patterns' spans and all spans; null text has none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    with_base = docs.withColumn(base_col, base_spans(text))
    return with_base.withColumn(all_col, F.array_sort(F.concat(base_col, added_spans(text, F.col(base_col), model))))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """Text with every stretch that the sorted spans cover replaced by ``mask``; spans that overlap share one mask."""

    def assembled(blocks: Column, ends: Column) -> Column:
        def piece(start: Column, end: Column) -> Column:
            """Code points from start to end; only the blocks that hold them are looked through."""
            first = F.floor(start / _BLOCK).cast("int")
            own = F.slice(blocks, first + 1, F.floor(end / _BLOCK).cast("int") - first + 1)
            return F.substring(F.array_join(own, ""), start - first * _BLOCK + 1, end - start)

        before = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
        gaps = F.filter(F.zip_with(spans, before, lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"))), lambda g: g["start"] >= g["at"])
        kept = F.transform(gaps, lambda g: F.concat(piece(g["at"], g["start"]), F.lit(mask)))
        return F.concat(F.array_join(kept, ""), piece(F.element_at(ends, -1), F.length(text)))

    ends = _running(F.transform(spans, lambda s: s["end"]), _MOST, 0)
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _let(blocks, lambda b: _let(ends, lambda e: assembled(b, e)))).otherwise(text)


def report(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no spans; repeated rows and null ids are reported row by row; other columns are not read.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    count = lambda rank: F.size(F.filter("_base", lambda s: s["rank"] == rank)).cast("long")
    return find(plain, model, "_text").select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(written(F.col("_base")), 256).alias("base_sha256"),
        written(F.col("_spans")).alias("spans"),
        (F.size("_spans") - F.size("_base")).cast("long").alias("n_markov"),
    )


def mask(docs: DataFrame, model: list[float], text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets masked in ``text_col`` and ``length_col`` (where there is one) set to the new length.

    Rows without a secret stay as they are; the columns keep their names and order.
    """
    names = docs.columns
    base, spans, text = (fresh(docs, f"secret_{x}") for x in ("base", "spans", "text"))
    found = find(docs, model, text_col, base, spans)
    hit = F.size(spans) > 0
    new = found.withColumn(text, masked(F.col(text_col), F.col(spans)))
    out = {c: F.col(f"`{c}`") for c in names}
    out[text_col] = F.col(text).alias(text_col)
    if length_col in names:
        kind = docs.schema[length_col].dataType
        out[length_col] = F.when(hit, F.length(text).cast(kind)).otherwise(F.col(f"`{length_col}`")).alias(length_col)
    return new.select(*[out[c] for c in names])
