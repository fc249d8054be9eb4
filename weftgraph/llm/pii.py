"""Personal data: fixed patterns, secrets, and terms that give protected entities away (information-theoretic sanitisation,
Sanchez and Batet, 2016). DataFrame functions only.

The patterns are rewritten so that Java's backtracking matcher runs in linear time on any text and finds the same
leftmost matches: a run of signs can only begin a match at its first sign, or where the last match ended (\\G),
and possessive quantifiers stand where giving back can't help.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._tables import stored

_LUHN = "aggregate(sequence(1, length(d)), 0L, (a, i) -> a + (int(substring(d, -i, 1)) * (2 - i % 2)) div 10 + (int(substring(d, -i, 1)) * (2 - i % 2)) % 10) % 10 = 0"
#: Kind, pattern, test of a match p (SQL).
KINDS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"p rlike '^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:[.]|$)){4}$'"),
    ("card", r"[0-9](?:[ -]?+[0-9])++", f"exists(array(translate(p, ' -', '')), d -> length(d) between 16 and 19 and {_LUHN})"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "length(translate(p, ' ().+-', '')) between 8 and 15"),
)
#: What a text must hold for a kind to be looked for.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: A run of 20 signs or more that has letters and digits: a key, a token.
SECRET = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+"
#: A word of four letters or more, or of two or three with a capital.
TERM = r"(?<![\p{L}\p{N}_-])(?:\p{L}[\p{L}'-]{3,}|\p{Lu}\p{L}{1,2})(?![\p{L}\p{N}_-])"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
#: Signs of a text that are looked up together.
REACH = 256


def _matches(text: str, pattern: str, kind: str, test: str) -> str:
    """SQL: the spans of the matches of pattern in the expression text. Matches are fenced by two signs that no
    pattern can match, and which the text doesn't hold; then every second piece is a match.

    A fold copies its state in each step, so pieces are folded 64 at a time, from where those before them end: a text with very many
    matches takes nearly linear time."""
    pieces = f"split(regexp_replace({text}, r'{pattern}', '\\u0001$0\\u0002'), '[\\u0001\\u0002]', -1)"
    chunks = "transform(sequence(0, (size(ps) - 1) div 64), c -> slice(ps, c * 64 + 1, 64))"
    sizes = "transform(cs, x -> aggregate(x, 0, (n, p) -> n + length(p)))"
    begins = f"aggregate({sizes}, array(0), (b, n) -> concat(b, array(element_at(b, -1) + n)))"
    found = f"named_struct('kind', '{kind}', 'start', s.at, 'end', s.at + length(p), 'value', p)"
    step = f"named_struct('i', s.i + 1, 'at', s.at + length(p), 'out', if(s.i % 2 = 1 and {test}, concat(s.out, array({found})), s.out))"
    fold = f"aggregate(x, named_struct('i', 0, 'at', b, 'out', cast(array() as {SPAN})), (s, p) -> {step}, s -> s.out)"
    spans = f"flatten(zip_with(cs, slice({begins}, 1, size(cs)), (x, b) -> {fold}))"
    # Lambdas over arrays of one element name what is used more than once.
    return f"transform(transform(array({pieces}), ps -> {chunks}), cs -> {spans})[0]"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", r"\x27")


def base_spans(text: Column | str = "text") -> Column:
    """The spans of all kinds, by kind as listed, then start. Positions in code points, end exclusive. Null: none."""
    clean = f"translate({text}, '\\u0001\\u0002', '\\ufffd\\ufffd')"
    parts = []
    for kind, pattern, test in KINDS:
        hint = f"contains({text}, '{HINTS[kind]}')" if HINTS[kind] else "true"
        hint += "" if kind == "email" else f" and {text} rlike '[0-9]'"
        parts.append(f"if({hint}, {_matches(clean, _quoted(pattern), kind, test)}, cast(array() as {SPAN}))")
    return F.expr(f"if({text} is null, cast(array() as {SPAN}), concat({', '.join(parts)}))")


def listed(spans: str) -> str:
    """SQL: kind:start:end of an array of spans, comma-joined."""
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def secret_spans(text: str = "text") -> Column:
    """The spans of :data:`SECRET`, in order."""
    clean = f"translate({text}, '\\u0001\\u0002', '\\ufffd\\ufffd')"
    found = _matches(clean, _quoted(SECRET), "secret", "true")
    return F.expr(f"if({text} rlike '[A-Za-z0-9_-]{{20}}', {found}, cast(array() as {SPAN}))")


def term_spans(text: str = "text") -> Column:
    """The spans of :data:`TERM`, in order; value is the term, in small letters."""
    clean = f"translate({text}, '\\u0001\\u0002', '  ')"
    return F.expr(f"transform({_matches(clean, _quoted(TERM), 'term', 'true')}, w -> named_struct('term', lower(w.value), 'start', w.start, 'end', w.end, 'name', lower(w.value) <> w.value))")


def row_key(id_col: str, text_col: str) -> Column:
    """96 bits of a row's id and text."""
    return F.struct(F.xxhash64(id_col, text_col).alias("a"), F.hash(id_col, text_col).alias("b"))


def near_terms(found: DataFrame, window: int) -> DataFrame:
    """(row, entity, term): once for each row in which the term stands within `window` signs of the entity. found: row, spans, words.

    Spans and words of a row meet by stretches of REACH signs, so a long text with many of both isn't a product."""
    last, first = F.floor((F.col("s.end") + window) / REACH), F.floor(F.greatest(F.col("s.start") - window, F.lit(0)) / REACH)
    spans = found.select("row", F.explode("spans").alias("s")).select("row", F.concat("s.kind", F.lit(":"), "s.value").alias("entity"), "s.start", "s.end", F.explode(F.sequence(first, last)).alias("at"))
    words = found.select("row", F.explode("words").alias("w")).select("row", "w.term", F.col("w.start").alias("from"), F.col("w.end").alias("to"), F.floor(F.col("w.start") / REACH).alias("at"))
    # A word that is part of an entity isn't a term beside it.
    return spans.join(words, ["row", "at"]).where(f"to > start - {window} and from < end + {window} and (to <= start or from >= end)").select("row", "entity", "term").distinct()


def disclosing(pairs: DataFrame, entities: DataFrame, terms: DataFrame, total: int, least: float) -> DataFrame:
    """(entity, term, told) with told of `least` or more: PMI(e; t) / IC(e), in rows. pairs: row, entity, term; entities: entity, n_e;
    terms: term, n_t."""
    both = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_et")).join(entities.where(f"n_e < {total}"), "entity").join(terms, "term")
    told = F.expr(f"log2({total}D * n_et / (n_e * n_t)) / log2({total}D / n_e)")
    return both.select("entity", "term", told.alias("told")).where(F.col("told") >= least)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 60, generalise: float = 0.85, remove: float = 0.97, broadcast_rows: int = 300_000) -> DataFrame:
    """(id, key, spans) for every row: base spans, then those of the kinds `secret`, `name` and `term` (generalise; a name has a capital) and
    `drop` (remove), by kind and start.

    An entity is the kind and value of a base span or secret. A term is a word of four letters or more, or of two or three with a
    capital, A-Z as a-z, within `window` code points before or after an entity in some row. Over all rows, PMI(e; t) = log2(N n(e,t) / (n(e) n(t)))
    estimates what t tells of e: n(e,t) counts the rows where t stands near e, n(e) those with e, n(t) those with t
    anywhere, repeated rows each time. t gives e away if PMI / IC(e) reaches `generalise`, where IC(e) = log2(N / n(e)) is all there is to know;
    from `remove` on, it is dropped. So a rare word beside an address that stands in one row goes too. In rows that hold e all occurrences of t are
    marked then, unless they touch another span. An entity in every row has nothing to give away. Null and empty texts have no
    spans. Ids may be null or repeat: rows are told apart by a hash of id and text (key). An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("key", row_key("id", "text"))
    found = rows.select("key", F.concat(base_spans(), secret_spans()).alias("spans"), "text").where("size(spans) > 0")
    found = stored(found.select("key", "spans", term_spans().alias("words")).withColumn("row", F.monotonically_increasing_id()), "spans")
    pairs = stored(near_terms(found, window), "pairs")
    held = found.select("row", F.explode("spans").alias("s")).select("row", F.concat("s.kind", F.lit(":"), "s.value").alias("entity")).distinct()
    entities = held.groupBy("entity").agg(F.count("*").alias("n_e"))
    wanted = stored(pairs.select("term").distinct(), "wanted")
    words = rows.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))).alias("term"))
    if wanted.count() <= broadcast_rows:
        words = words.join(F.broadcast(wanted), "term", "left_semi")
    counts = words.groupBy("term").agg(F.count("*").alias("n_t"))
    told = stored(disclosing(pairs, entities, counts, rows.count(), generalise), "told")
    # Per row the disclosing terms of its entities that it holds, then all their places. Rows and terms meet by entity and term, so an entity
    # of many rows and many terms is no product of both.
    telling = told.select("term").distinct()
    inside = found.select("row", F.explode(F.expr("array_distinct(transform(words, w -> w.term))")).alias("term")).join(telling, "term", "left_semi")
    marked = held.join(inside, "row").join(told, ["entity", "term"]).groupBy("row", "term").agg(F.max("told").alias("told")).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "told"))).alias("told"))
    kind = f"case when told[w.term] >= {remove} then 'drop' when w.name then 'name' else 'term' end"
    hits = "filter(words, w -> map_contains_key(told, w.term) and not exists(spans, s -> w.start < s.end and s.start < w.end))"
    terms = f"array_sort(transform({hits}, w -> named_struct('kind', {kind}, 'start', w.start, 'end', w.end, 'value', cast(null as string))))"
    order = "concat(filter({0}, t -> t.kind = 'name'), filter({0}, t -> t.kind = 'term'), filter({0}, t -> t.kind = 'drop'))".replace("{0}", "terms")
    both = found.join(marked, "row", "left").withColumn("terms", F.expr(f"if(told is null, cast(array() as {SPAN}), {terms})"))
    # Equal rows have equal spans.
    both = both.select("key", F.concat("spans", F.expr(order)).alias("spans")).groupBy("key").agg(F.first("spans").alias("spans"))
    out = rows.select("id", "key").join(both, "key", "left")
    return out.select(F.col("id").alias(id_col), "key", F.coalesce("spans", F.expr(f"cast(array() as {SPAN})")).alias("spans"))


def sanitised(text: str, spans: str) -> Column:
    """SQL expressions of a text and its spans (of find_pii): the text with each span as its kind in angle brackets,
    dropped terms left out. Where spans overlap, the first one counts."""
    order = f"array_sort({spans}, (a, b) -> case when a.start < b.start then -1 when a.start > b.start then 1 else b.end - a.end end)"
    label = "if(s.kind = 'drop', '', concat('<', upper(s.kind), '>'))"
    step = f"if(s.start < a.at, a, named_struct('at', s.end, 'out', concat(a.out, array(substring({text}, a.at + 1, s.start - a.at), {label}))))"
    joined = f"aggregate({order}, named_struct('at', 0, 'out', cast(array() as array<string>)), (a, s) -> {step}, a -> concat(array_join(a.out, ''), substring({text}, a.at + 1)))"
    return F.expr(f"if(size({spans}) = 0, {text}, {joined})")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """The rows of docs with sanitised texts; other columns stay. Null texts stay null."""
    found = find_pii(docs, id_col, text_col, **options).where("size(spans) > 0").dropDuplicates(["key"]).select("key", "spans")
    # The columns of docs travel in one struct, so their names can't clash.
    rows = docs.select(F.struct(docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("key", row_key("id", "text")).join(found, "key", "left")
    clean = rows.select("row", F.when(F.col("spans").isNull(), F.col("text")).otherwise(sanitised("text", "spans")).alias("text"))
    return clean.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))
