"""Line dedup by a segment-partition edit join, in DataFrame operations alone.

Two lines are near if at most ``limit(n)`` edits part them, n being the length
of the shorter in code points (see LEVELS).  Lines that are equal, near, or
joined by a chain of near lines are a class; its first line (smallest doc_id,
then line number) stays, the others go.

1.  A line of n code points, limit k, is cut into k + 1 segments of one size,
    the first half of them placed from its beginning, the others from its end.
    Of two lines at most k edits apart, some segment i stands unchanged with
    exactly i edits before it and at most k - i after it, so it has moved by at
    most min(i, k - i) from its place.  Each line gives the substrings that
    begin 0 to min(i, k - i) code points behind that place: whatever the move,
    one of the one line's is one of the other's.  Sizes follow from a range of
    lengths, and a line near a range's end gives the next one's substrings too.
2.  Keys (hashes of level, range, segment, substring) are counted with partial
    aggregation to (key, least line, greatest line); a line that fills a third
    of the corpus is a row a task.  Only rows of keys that several lines give
    are made again, as hashes; the texts of their lines are looked up once.
3.  Every line of a key is held against the least and the greatest one: a row a
    line, not a row a pair.  What that links is one class.  Then lines of a key
    that are not yet of one class are held against each other, all of them, so
    no near pair is left out that could join two classes.
4.  Pairs are held against counts of letters, which differ by at most two an edit,
    and the built-in distance, then verified by banded bit-parallel distance.

Near lines have at least 12 code points; equal lines of any length go.  Lines
without a word are left alone.  Null text: no lines.  Identical rows are one
document and keep the same lines; rows that share a doc_id with other texts are
documents of their own, in the order of a hash.  A row without a doc_id is named by its text and comes last.  An
empty table gives no rows.  Very long lines are lines like others.  Extra
columns are kept by ``dedup`` and not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.common import materialise, own_column, partitions, table
from claimloom.llm.components import components

#: (length from which it holds, edits, lengths of a range)
LEVELS = ((12, 1, 8), (24, 2, 16), (96, 3, 32), (192, 4, 32))
MIN_CHARS, MAX_EDITS = LEVELS[0][0], LEVELS[-1][1]
#: Rows that are broadcast at most; beyond, the same join shuffles, with the same result.
BROADCAST_ROWS = 1_000_000
#: Columns of the band that are looked at first; empty characters around a line.
LOOK, PAD = 24, 2 * MAX_EDITS
#: A place's line number (31 bits) and 30 bits of its text's hash, as one number.
_REF, _TAG = 1 << 61, 30
#: Signs that are counted in a line's first and second half.
SIGNS = "etaoinsrhldcumfpgwybvk ."
_COUNTS = [f"{half}{k}" for half in "pq" for k in range(len(SIGNS))]
_CLASH = "_claimloom_"
#: What names a text of a doc_id, or of none.
_WHOSE = ("id", "none", "t1", "t2")


def whose(doc_id: Column, text: Column) -> tuple[Column, ...]:
    """``id`` and ``none``, and 128 bits that stand for the text."""
    return F.coalesce(doc_id.cast("long"), F.lit(0)), doc_id.isNull(), F.xxhash64(text), F.xxhash64(F.lit(1), text)


def limit(n: str) -> str:
    """SQL for the most edits of a pair whose shorter line has ``n`` code points."""
    return "CASE " + " ".join(f"WHEN {n} >= {low} THEN {k}" for low, k, _ in reversed(LEVELS)) + " ELSE 0 END"


def bounded(df: DataFrame, weight: str = "1") -> DataFrame:
    """``df`` marked for broadcast if its checked number of rows (each counted ``weight`` times) allows."""
    held = df.agg(F.coalesce(F.sum(F.expr(weight)), F.lit(0)), F.count("*")).first()
    return F.broadcast(df) if max(held) <= BROADCAST_ROWS else df


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, k, line): every line with a word, its number and 128 bits that stand for its text."""
    # hashes first: beside the explode they would be computed once a line
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), F.col("text")).alias("t2"))
    split = rows.select("doc_id", "t1", "t2", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    word = F.expr(r"ascii(ltrim(line)) > 32") | F.col("line").rlike(r"[^\x20\x09-\x0D]")  # the first spares most lines the pattern
    return split.filter(word)


def hashed(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, t1, t2, k): 128 bits that stand for a line, and where it is."""
    return lines(docs).select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"), "doc_id", "t1", "t2", "k")


#: A line's place as one decimal, which hash aggregation can hold: doc_id (the text's hash and after all others, if null), line number, bits of the text's hash.
PLACE = (
    f"cast((cast(coalesce(doc_id, t2) as decimal(20,0)) + if(doc_id IS NULL, {3 << 63}BD, {1 << 63}BD)) * {_REF}BD"
    f" + cast(shiftleft(cast(k as bigint), {_TAG}) + shiftright(pmod(t1, 4294967296), {32 - _TAG}) as decimal(20,0)) as decimal(38,0))"
)


def doc_of(p: str) -> str:
    """Null for a row without a doc_id."""
    doc = f"cast((({p}) - pmod({p}, {_REF}BD)) / {_REF}BD as decimal(20,0))"
    return f"if({p} >= {1 << 64}BD * {_REF}BD, null, cast({doc} - {1 << 63}BD as bigint))"


def line_of(p: str) -> str:
    return f"cast(shiftright(cast(pmod({p}, {_REF}BD) as bigint), {_TAG}) as int)"


def _substrings(k: int) -> list[tuple[int, int]]:
    """(segment, places behind its own) of a line's substrings at limit ``k``."""
    return [(i, x) for i in range(k + 1) for x in range(min(i, k - i) + 1)]


def keyed(docs: DataFrame) -> DataFrame:
    """(key, h, line): the substrings' keys of each line, and a hash of the line."""
    rows = lines(docs).select("line", F.length("line").alias("n")).filter(F.col("n") >= MIN_CHARS)
    ranges = []  # (k, range, code points that all its lines have), of its own range and of the one that a longer line near it can have
    for (low, k, width), high in zip(LEVELS, [x[0] - 1 for x in LEVELS[1:]] + [(1 << 31) - 100], strict=True):
        for at, held in ((f"n div {width}", "true"), (f"(n + {k}) div {width}", f"(n + {k}) div {width} > n div {width}")):
            ranges.append(f"if(n BETWEEN {low} AND {high + k} AND {held}, named_struct('k', {k}, 'b', cast({at} as int), 's', cast(greatest({low}, {width} * ({at}) - {k}) as int) div {k + 1}), null)")
    rows = rows.select("line", "n", F.explode(F.expr(f"array({', '.join(ranges)})")).alias("r")).filter("r IS NOT NULL")
    rows = rows.select("line", "n", "r.k", "r.b", F.col("r.s").cast("int").alias("s"))
    by_level = {k: _substrings(k) for _, k, _ in LEVELS}
    keys = []
    for at in range(max(map(len, by_level.values()))):
        cases = []
        for k, found in by_level.items():
            if at < len(found):
                i, x = found[at]
                size = f"s - {min(i, k - i)}"
                start = f"{i} * s + {x}" if i <= k - i else f"n - {k - i} * s - {x} - ({size})"
                cases.append(f"WHEN {k} THEN xxhash64({k}, b, {i}, substring(line, {start} + 1, {size}))")
        keys.append(f"CASE k {' '.join(cases)} END")
    rows = rows.select("line", F.explode(F.expr(f"array({', '.join(keys)})")).alias("key")).filter("key IS NOT NULL")
    return rows.select("key", F.xxhash64("line").alias("h"), "line")


def _band(a: str, b: str, columns: str, k: str, most: int = MAX_EDITS) -> str:
    """SQL for the state of the banded bit-parallel edit distance after some columns.

    ``a`` (not the longer, of more than ``most`` characters) and ``b`` are arrays of
    characters, ``a`` with PAD empty strings at both ends.  Bit r of a word
    stands for row j + most - (bits - 1) + r of column j: the band moves down a
    row a column.  ``d`` follows the lowest diagonal of the band to the last
    row, and then that row; more than k + 2 * most can't come back to k.
    """
    bits = 2 * most + 2
    mask, top = (1 << bits) - 1, bits - 1
    n = f"(size({a}) - {2 * PAD})"
    equal = " | ".join(f"if({a}[j + {most - top + r - 1 + PAD}] = {b}[j - 1], {1 << r}L, 0L)" for r in range(bits))
    return f"""aggregate({columns},
      named_struct('vp', {((1 << (most + 1)) - 1) << (bits - most - 1)}L, 'vn', 0L, 'd', {most}),
      (s, j) -> if(s.d > {k} + {2 * most}, s, element_at(transform(array({equal}), x ->
        element_at(transform(array(((((x & s.vp) + s.vp) ^ s.vp) | x | s.vn) & {mask}L), d0 ->
          element_at(transform(array(named_struct('hp', (s.vn | ~(d0 | s.vp)) & {mask}L, 'hn', d0 & s.vp)), h ->
            named_struct(
              'vp', (h.hn | ~(shiftrightunsigned(d0, 1) | h.hp)) & {mask}L,
              'vn', shiftrightunsigned(d0, 1) & h.hp,
              'd', if(j <= {n} - {most},
                s.d + if(shiftrightunsigned(d0, {top}) & 1L = 0L, 1, 0),
                s.d + cast(shiftrightunsigned(h.hp, {top} - (j - ({n} - {most}))) & 1L as int)
                    - cast(shiftrightunsigned(h.hn, {top} - (j - ({n} - {most}))) & 1L as int)))), 1)), 1)), 1)))"""


def edit_distance(a: str, b: str, k: str) -> str:
    """SQL for the edit distance of character arrays (see ``_band``), exact up to ``k``; more than that where it is more.

    A few columns tell most pairs that are far apart.
    """
    far = f"{k} + 1"
    some = _band(a, b, f"sequence(1, least({LOOK}, size({b})))", k)
    return f"if(({some}).d > {k} + {2 * MAX_EDITS}, {far}, ({_band(a, b, f'sequence(1, size({b}))', k)}).d)"


def _common(a: str, b: str) -> str:
    """SQL for the length of the common beginning of two strings, by binary search."""
    return f"""aggregate(sequence(1, 31), named_struct('lo', 0, 'hi', least(length({a}), length({b}))),
      (s, i) -> if(s.lo >= s.hi, s, if(left({a}, (s.lo + s.hi + 1) div 2) = left({b}, (s.lo + s.hi + 1) div 2),
        named_struct('lo', cast((s.lo + s.hi + 1) div 2 as int), 'hi', s.hi),
        named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi + 1) div 2 as int) - 1))), s -> s.lo)"""


def trimmed(pairs: DataFrame) -> DataFrame:
    """Adds ``a`` and ``b``: the lines' characters between their common beginning and end, a few of the beginning kept."""
    keep = MAX_EDITS + 1
    rows = pairs.withColumn("_p", F.expr(f"greatest(0, {_common('a_line', 'b_line')} - {keep})"))
    rows = rows.withColumn("_a", F.expr("substring(a_line, _p + 1)")).withColumn("_b", F.expr("substring(b_line, _p + 1)"))
    rows = rows.withColumn("_ra", F.reverse("_a")).withColumn("_rb", F.reverse("_b"))
    rows = rows.withColumn("_s", F.expr(f"greatest(0, least({_common('_ra', '_rb')}, length(_a) - {keep}))"))
    pad = F.array_repeat(F.lit(""), PAD)
    rows = rows.withColumn("a", F.concat(pad, F.split(F.expr("left(_a, length(_a) - _s)"), ""), pad)).withColumn("b", F.split(F.expr("left(_b, length(_b) - _s)"), ""))
    return rows.drop("_p", "_a", "_b", "_ra", "_rb", "_s")


def verified(pairs: DataFrame) -> DataFrame:
    """(u, v): the ``pairs`` (u, v, a_line, b_line) of lines that are near."""
    swap = F.expr("length(a_line) > length(b_line)")
    ordered = pairs.select("u", "v", F.when(swap, F.col("b_line")).otherwise(F.col("a_line")).alias("a_line"), F.when(swap, F.col("a_line")).otherwise(F.col("b_line")).alias("b_line"))
    # few bytes, but much to compute; written, since a filter would else be moved down and compute the arrays at each use
    spread = materialise(trimmed(ordered.repartition(partitions(pairs.sparkSession))), "line-pairs")
    most = limit("length(a_line)")
    return spread.filter(F.expr(f"{edit_distance('a', 'b', f'({most})')} <= {most}")).select("u", "v")


def _like(a: str, b: str) -> str:
    """SQL: lengths and letter counts allow the limit; counts are of the first and last code points that lines of a range all have."""
    most = limit(f"least({a}n, {b}n)")
    apart = " + ".join(f"abs({a}{c} - {b}{c})" for c in _COUNTS)
    return f"abs({a}n - {b}n) <= {most} AND ({a}base <> {b}base OR {apart} <= 2 * ({most}))"


def _seems_near(a: str, b: str) -> str:
    """SQL: the built-in distance doesn't exceed the limit; it spares far pairs the arrays of ``verified``."""
    return f"levenshtein({a}line, {b}line, {limit(f'least({a}n, {b}n)')}) >= 0"


def met(docs: DataFrame, several: DataFrame) -> DataFrame:
    """(key, low, high, h): the lines of the keys that several lines give, by hashes alone: a line has many keys, and its text may be long."""
    return keyed(docs).select("key", "h").join(bounded(several), "key").distinct().select("key", "low", "high", "h")


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, line): the texts of the lines ``wanted`` (h), each once."""
    every = lines(docs).filter(F.length("line") >= MIN_CHARS).select(F.xxhash64("line").alias("h"), "line")
    return every.join(bounded(wanted), "h", "left_semi").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """(h1, h2, class): each distinct line that is near another one, and the number of its class."""
    several = materialise(keyed(docs).groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low < high"), "line-keys")
    hits = materialise(met(docs, several), "line-hits")
    base = "CASE " + " ".join(f"WHEN n >= {low} THEN greatest({low}, {width} * (n div {width}) - {k})" for low, k, width in reversed(LEVELS)) + " END"
    held = line_texts(docs, materialise(hits.select("h").distinct(), "line-met")).withColumn("n", F.length("line")).withColumn("base", F.expr(f"cast({base} as int)"))
    held = held.withColumn("p", F.expr("left(line, base div 2)")).withColumn("q", F.expr("right(line, base - base div 2)"))
    counts = [F.expr(f"length({half}) - length(replace({half}, '{x}', ''))").alias(f"{half}{k}") for half in "pq" for k, x in enumerate(SIGNS)]
    held = materialise(held.select(F.monotonically_increasing_id().alias("node"), "h", "line", "n", "base", *counts), "line-texts")
    signs = ["node", "h", "n", "base", *_COUNTS]

    def side(name: str, *columns: str) -> DataFrame:
        return held.select(*[F.col(c).alias(f"{name}_{c}") for c in columns])

    ends = hits.select(F.col("low").alias("a_h"), F.col("h").alias("b_h")).unionByName(hits.select(F.col("high").alias("a_h"), F.col("h").alias("b_h")))
    ends = ends.filter("a_h <> b_h").distinct()
    star = ends.join(side("a", *signs, "line"), "a_h").join(side("b", *signs, "line"), "b_h").filter(f"{_like('a_', 'b_')} AND {_seems_near('a_', 'b_')}")
    links = materialise(verified(star.select(F.col("a_node").alias("u"), F.col("b_node").alias("v"), "a_line", "b_line")), "line-links")

    named = materialise(components(links), "line-stars")
    member = hits.select("key", "low", "high", "h").join(held.select(*signs, "line"), "h").join(named, "node", "left").withColumn("c", F.coalesce("component", "node"))
    mixed = member.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).filter("least < most").select("key")
    rest = materialise(member.filter("h <> low AND h <> high").join(mixed.hint("shuffle_merge"), "key", "left_semi").select("key", "c", *signs, "line"), "line-members")
    own = rest.groupBy("node").agg(F.collect_set("key").alias("keys"))  # bounded by the line's level
    rest = rest.join(own.hint("shuffle_merge"), "node")
    a = rest.select("key", *[F.col(c).alias(f"a_{c}") for c in ["c", "keys", *signs, "line"]])
    b = rest.select(F.col("key").alias("b_key"), *[F.col(c).alias(f"b_{c}") for c in ["c", "keys", *signs, "line"]])
    # a pair meets under the least of its common keys alone
    meet = F.expr(f"key = b_key AND a_c < b_c AND {_like('a_', 'b_')} AND key = array_min(array_intersect(a_keys, b_keys)) AND {_seems_near('a_', 'b_')}")
    apart = a.join(b.hint("shuffle_merge"), meet)
    more = verified(apart.select(F.col("a_node").alias("u"), F.col("b_node").alias("v"), "a_line", "b_line"))
    last = components(named.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    return held.join(last, "node").select(F.col("h").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"), F.col("component").alias("class"))


def verdicts(docs: DataFrame) -> DataFrame:
    """(id, none, t1, t2, gone): for each text of a doc_id (``none``: of no doc_id) the lines that go, as (k, equal, doc, line), the last two being the place of their class's first line."""
    every = hashed(docs)
    near = materialise(classes(docs), "line-classes")
    first = every.groupBy("h1", "h2").agg(F.min(F.expr(PLACE)).alias("first"), F.count("*").alias("times")).join(bounded(near), ["h1", "h2"], "left")
    first = materialise(first.filter("times > 1 OR class IS NOT NULL"), "line-firsts")
    stays = first.filter("class IS NOT NULL").groupBy("class").agg(F.min("first").alias("stays"))
    named = first.join(bounded(stays), "class", "left").select("h1", "h2", "first", F.coalesce("stays", "first").alias("stays"))
    # a row a distinct line that is repeated or near another: broadcast if few, else the join can split a hot line
    gone = every.join(bounded(materialise(named, "line-verdicts")), ["h1", "h2"]).withColumn("p", F.expr(PLACE)).filter("p <> stays")
    entry = F.struct("k", (F.col("p") != F.col("first")).alias("equal"), F.expr(doc_of("stays")).alias("doc"), F.expr(line_of("stays")).alias("line"))
    per = gone.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "t1", "t2", entry.alias("x"))
    return materialise(per.groupBy("id", "none", "t1", "t2").agg(F.sort_array(F.collect_set("x")).alias("gone")), "line-gone")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines that go cut out of the text."""
    own = {c: f"{_CLASH}{k}" for k, c in enumerate(docs.columns)}
    text, doc_id = own["text"], own["doc_id"]
    gone = verdicts(docs).select(*[F.col(c).alias(f"_{c}") for c in _WHOSE], F.transform("gone", lambda x: x.k).alias("_gone"))
    rows = docs.select(*[own_column(c).alias(v) for c, v in own.items()])
    named = dict(zip(_WHOSE, whose(F.col(doc_id), F.col(text)), strict=True))
    rows = rows.select("*", *[v.alias(f"_{c}") for c, v in named.items()])
    kept = F.expr(f"array_join(transform(filter(transform(split({text}, '\\n'), (x, i) -> named_struct('x', x, 'i', i)), y -> NOT array_contains(_gone, y.i)), y -> y.x), '\\n')")
    joined = rows.join(bounded(gone, "size(_gone)"), [f"_{c}" for c in _WHOSE], "left")
    return joined.select(*[(F.when(F.col("_gone").isNull(), F.col(v)).otherwise(kept) if c == "text" else F.col(v)).alias(c) for c, v in own.items()])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those that go for an equal or a near line, their numbers, and the class of each (place of the line that stays)."""
    docs = table(spark, sf_dir, "documents")
    found = verdicts(docs)
    named = [v.alias(c) for c, v in zip(_WHOSE, whose(F.col("doc_id"), F.col("text")), strict=True)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *named, F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n"))
    none = F.expr("cast(array() as array<struct<k:int,equal:boolean,doc:bigint,line:int>>)")
    joined = rows.join(bounded(found, "size(gone)"), list(_WHOSE), "left").withColumn("gone", F.coalesce("gone", none))
    return joined.select(
        "doc_id",
        F.when(F.col("n") < 0, 0).otherwise(F.col("n")).cast("long").alias("n_lines"),
        F.expr("cast(size(filter(gone, x -> x.equal)) as bigint)").alias("n_equal"),
        F.expr("cast(size(filter(gone, x -> NOT x.equal)) as bigint)").alias("n_near"),
        F.expr("array_join(transform(gone, x -> cast(x.k as string)), ',')").alias("removed_lines"),
        F.expr(f"array_join(transform(gone, x -> concat(coalesce(cast(x.doc as string), 'null'), ':', cast(x.line as string))), ',')").alias("classes"),
    )


#: The same by brute force over lines of like length; the letter counts only spare it some distances.
#: Its levenshtein counts bytes, so a pair's letters (up to 127 different ones) are first named by one byte each.
OP1_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, k - 1 AS k, parts[k] AS x
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM split)
  WHERE regexp_matches(parts[k], '[^\x20\x09-\x0D]')
), firsts AS (
  SELECT x, min(struct_pack(doc_id := doc_id, k := k)) AS p, length(x) AS n,
    CASE WHEN length(x) >= 192 THEN 4 WHEN length(x) >= 96 THEN 3 WHEN length(x) >= 24 THEN 2 WHEN length(x) >= 12 THEN 1 ELSE 0 END AS most,
    length(replace(x, 'e', '')) AS c1, length(replace(x, 't', '')) AS c2, length(replace(x, 'a', '')) AS c3,
    length(replace(x, 'n', '')) AS c4, length(replace(x, 'o', '')) AS c5, length(replace(x, 'i', '')) AS c6,
    length(replace(x, 'r', '')) AS c7, length(replace(x, 'h', '')) AS c8, length(replace(x, 's', '')) AS c9
  FROM lines GROUP BY x
), links AS (
  SELECT a.p AS u, b.p AS v
  FROM firsts a JOIN firsts b ON a.most > 0 AND b.n - a.n BETWEEN 0 AND a.most AND (a.n < b.n OR a.p < b.p)
    AND abs((b.n - b.c1) - (a.n - a.c1)) + abs((b.n - b.c2) - (a.n - a.c2)) + abs((b.n - b.c3) - (a.n - a.c3))
      + abs((b.n - b.c4) - (a.n - a.c4)) + abs((b.n - b.c5) - (a.n - a.c5)) + abs((b.n - b.c6) - (a.n - a.c6))
      + abs((b.n - b.c7) - (a.n - a.c7)) + abs((b.n - b.c8) - (a.n - a.c8)) + abs((b.n - b.c9) - (a.n - a.c9)) <= 2 * a.most
  WHERE CASE WHEN strlen(a.x || b.x) = length(a.x || b.x) THEN levenshtein(a.x, b.x)
    ELSE levenshtein(translate(a.x, array_to_string(list_distinct(string_split(a.x || b.x, '')), ''), array_to_string([chr(CAST(c AS INTEGER)) FOR c IN range(1, 128)], '')), translate(b.x, array_to_string(list_distinct(string_split(a.x || b.x, '')), ''), array_to_string([chr(CAST(c AS INTEGER)) FOR c IN range(1, 128)], ''))) END <= a.most
), ends AS (
  SELECT u, v FROM links UNION SELECT v, u FROM links
), reach AS (
  SELECT u, u AS v FROM ends UNION SELECT r.u, e.v FROM reach r JOIN ends e ON r.v = e.u
), stays AS (
  SELECT u, min(v) AS p FROM reach GROUP BY u
), judged AS (
  SELECT l.doc_id, l.k, struct_pack(doc_id := l.doc_id, k := l.k) AS own, f.p AS first, coalesce(s.p, f.p) AS class
  FROM lines l JOIN firsts f ON f.x = l.x LEFT JOIN stays s ON s.u = f.p
), per AS (
  SELECT doc_id, count(*) FILTER (own <> first) AS n_equal, count(*) FILTER (own = first) AS n_near,
    string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS removed_lines,
    string_agg(CAST(class.doc_id AS VARCHAR) || ':' || CAST(class.k AS VARCHAR), ',' ORDER BY k) AS classes
  FROM judged WHERE own <> class GROUP BY doc_id
)
SELECT s.doc_id, CAST(coalesce(len(s.parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_equal, 0) AS BIGINT) AS n_equal,
  CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, coalesce(removed_lines, '') AS removed_lines, coalesce(classes, '') AS classes
FROM split s LEFT JOIN per p ON p.doc_id = s.doc_id
"""
