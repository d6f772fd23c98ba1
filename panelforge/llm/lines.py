"""Near-duplicate lines by a segment-partition edit join, in DataFrame and SQL functions only.

Two lines within `edits` edits: the shorter one, cut into edits + 1 segments, has a segment that the longer one holds
unchanged, near the same place. So each distinct line is indexed by its segments, under its length, and probes the
segments of every length down to its own less `edits`, at the few places that the edits left and right of a segment
allow. What lines that share a segment have besides is cut and probed in the same way. Pairs that meet are verified by
a banded bit-parallel edit distance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import broadcast_few, connected_components, through_table

EDITS = 2
#: Shorter lines are copies only of equal lines: two edits make another line of them.
LEAST_CHARS = 20
#: Verdicts that a broadcast may hold; more go through a shuffle.
WIDE_ROWS = 200_000
#: Numbers that a broadcast of removed lines may hold.
BROADCAST_ROWS = 2_000_000


def tries(edits: int) -> list[tuple[int, int, int]]:
    """(less, i, shift): a line probes segment i of the lines that are `less` shorter, `shift` places on from where it
    stands there. The first edits + 1 are its own segments, which are stored, and probe lines of its own length too."""
    own = [(0, i, 0) for i in range(edits + 1)]
    shifts = lambda less, i: range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)
    return own + [t for less in range(edits + 1) for i in range(edits + 1) for s in shifts(less, i) if (t := (less, i, s)) not in own]


def cut(edits: int, n: str, less, i, shift) -> tuple[str, str]:
    """SQL for the start (from 1) and the length of segment i of a line that is `less` shorter than n, `shift` places on;
    the later segments take what doesn't divide evenly."""
    length, parts = f"({n} - {less})", edits + 1
    before = [f"IF({i} > {k}, ({length} + {k}) div {parts}, 0)" if isinstance(i, str) else f"({length} + {k}) div {parts}" for k in range(edits if isinstance(i, str) else i)]
    return f"CAST({' + '.join(['1', *before])} + {shift} AS INT)", f"CAST(({length} + {i}) div {parts} AS INT)"


def segment_keys(edits: int) -> str:
    """SQL for the array of keys of `line`, of n characters, in the order of tries; null where a probe doesn't fit.

    It stands within an aggregate function, where the compiler cuts the array's elements into methods of their own and
    only the first of equal lines makes keys.
    """
    keys = []
    for less, i, shift in tries(edits):
        start, size = cut(edits, "n", less, i, shift)
        key = f"xxhash64(n - {less}, {i}, substring(line, {start}, {size}))"
        fits = f"n >= {LEAST_CHARS + less}" + f" AND {start} >= 1 AND {start} + {size} <= n + 1" * (shift != 0)
        keys.append(f"IF({fits}, {key}, NULL)")
    return f"array({', '.join(keys)})"


#: Characters whose counts bound the edit distance from below: an edit changes two counts by one, at most.
COUNTED = ("etaoinshrdlu", "0123456789cm")


def letter_counts(letters: str) -> str:
    """SQL: how often `line` has each of the letters, modulo 32, five bits each."""
    chars = ", ".join(f"'{c}'" for c in letters)
    return f"aggregate(array({chars}), 0L, (s, c) -> s * 32L + (octet_length(line) - octet_length(replace(line, c, ''))) % 32)"


def letters_apart(pairs: list[tuple[str, str]]) -> str:
    """SQL: a lower bound on twice the edits between two lines, from their letter counts."""
    each = [f"abs((shiftright({a}, {5 * i}) & 31L) - (shiftright({b}, {5 * i}) & 31L))" for (a, b), letters in zip(pairs, COUNTED) for i in range(len(letters))]
    return " + ".join(f"least({d}, 32L - {d})" for d in each)


def pieces_lost(edits: int) -> str:
    """SQL: how many pieces of line la don't stand in line lb within `edits` places; an edit loses one, at most."""
    n = 4 * (edits + 1)
    start, end = (f"(1 + ({k}) * char_length(la) div {n})" for k in ("k", "k + 1"))
    low = f"greatest(1, {start} - {edits})"
    piece, window = f"substring(la, CAST({start} AS INT), CAST({end} - {start} AS INT))", f"substring(lb, CAST({low} AS INT), CAST({end} + {edits} - {low} AS INT))"
    return f"aggregate(sequence(0, {n - 1}), 0, (s, k) -> s + IF(instr({window}, {piece}) = 0, 1, 0))"


def distance(edits: int, a: str = "a", b: str = "b") -> str:
    """SQL: the edit distance of strings a and b if it is at most `edits`, else some larger number.

    A band of 2 * edits + 1 rows around the diagonal is held in the bits of vp and vn (where the distance grows or falls
    by one from the row above), and moves down a row with each character of b. d0 has the rows whose distance equals
    the one up and left; along the diagonal that ends in the last cell, its zeros are the edits.
    """
    band = (1 << (2 * edits + 1)) - 1
    match = " | ".join(f"IF(get(x.a, j + {k - edits - 1}) = get(x.b, j - 1), {1 << k}L, 0L)" for k in range(2 * edits + 1))
    start = sum(1 << k for k in range(edits, 2 * edits + 1))  # column 0 in the frame of column 1: rows 1 and on
    off = "(size(x.a) - size(x.b))"
    d0 = f"(((((m.bits & s.vp) + s.vp) ^ s.vp) | m.bits | s.vn) & {band}L)"
    step = f"struct((d & s.vp) | (~(shiftright(d, 1) | (s.vn | ~(d | s.vp))) & {band}L) AS vp, shiftright(d, 1) & (s.vn | ~(d | s.vp)) & {band}L AS vn, s.cost + IF(m.j + {off} >= 1 AND shiftright(d, CAST({off} + {edits} AS INT)) & 1L = 0L, 1L, 0L) AS cost)"
    columns = f"transform(IF(size(x.b) = 0, array(), sequence(1, size(x.b))), j -> struct(j AS j, {match} AS bits))"
    run = f"aggregate({columns}, struct({start}L AS vp, 0L AS vn, CAST(abs({off}) AS BIGINT) AS cost), (s, m) -> transform(array({d0}), d -> {step})[0], s -> s.cost)"
    chars = "filter(split({0}, ''), c -> c != '')"
    return f"IF(abs(char_length({a}) - char_length({b})) > {edits}, CAST({edits + 1} AS BIGINT), transform(array(struct({chars.format(a)} AS a, {chars.format(b)} AS b)), x -> {run})[0])"


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, dh, pos, line, h1, h2) for each line that isn't blank; dh is a hash of the text, h1 and h2 of the line."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("dh"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    solid = "ltrim(concat(' ', char(9), char(11), char(12), char(13)), line) != ''"
    return rows.where(solid).select("doc_id", "dh", "pos", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def links(docs: DataFrame, edits: int = EDITS) -> tuple[DataFrame, DataFrame]:
    """(distinct lines, links between them). Lines: h1, h2, copies, first (the place of the first one). Links: the hashes
    a1, a2, b1, b2 of the two lines, and edits."""
    rows = line_rows(docs).withColumn("n", F.char_length("line"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "dh", "pos")
    keys = F.expr(f"first(IF(n >= {LEAST_CHARS}, {segment_keys(edits)}, NULL))")
    lines = through_table(rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("copies"), keys.alias("keys")), "lines")
    # a key goes on if two lines have it: each task sends a key once, so one that all lines have is no task's burden
    keyed = lines.select("h1", F.posexplode("keys").alias("j", "key")).where("key is not null")
    shared = through_table(keyed.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo != hi").select("key"), "line-keys")
    entries = through_table(keyed.join(broadcast_few(shared), "key", "left_semi"), "line-entries")
    wanted = through_table(entries.select("h1").distinct(), "line-wanted")
    texts = through_table(line_rows(docs).join(broadcast_few(wanted), "h1", "left_semi").select("h1", "h2", "line").distinct(), "line-texts")
    met = through_table(meetings(entries, texts, edits), "line-pairs")
    pairs = met.join(texts.select(F.col("h1").alias("a"), F.col("h2").alias("a2"), F.col("line").alias("la")), "a").join(texts.select(F.col("h1").alias("b"), F.col("h2").alias("b2"), F.col("line").alias("lb")), "b")
    pairs = pairs.where(f"{pieces_lost(edits)} <= {edits}")
    checked = pairs.select(F.col("a").alias("a1"), "a2", F.col("b").alias("b1"), "b2", F.expr(distance(edits, "la", "lb")).alias("edits")).where(f"edits <= {edits}")
    return lines.drop("keys"), through_table(checked, "line-links")


def meetings(entries: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, b) of line hashes that share a segment, share a segment of what the lines have besides, and have like letters.

    The matched segments of two lines are equal, so all edits lie in the rest: cut into segments in its turn, it has one
    that the other's rest holds. So lines that share a frequent segment and nothing more don't meet.
    """
    parts = edits + 1
    tried = ", ".join(f"struct({less} AS less, {i} AS i, {shift} AS shift)" for less, i, shift in tries(edits))
    start, size = cut(edits, "n", "x.less", "x.i", "x.shift")
    found = entries.join(texts, "h1").withColumn("n", F.char_length("line")).withColumn("x", F.expr(f"array({tried})[j]"))
    counts = [F.expr(letter_counts(c)).alias(f"c{k}") for k, c in enumerate(COUNTED)]
    rest = F.expr(f"concat(substring(line, 1, {start} - 1), substring(line, {start} + {size}, n))").alias("rest")
    found = found.select("key", "h1", "j", "x", "n", F.expr(f"n - {size}").alias("m"), rest, *counts)
    start, size = cut(edits, "m", "y.less", "y.i", "y.shift")
    fits = f"{start} >= 1 AND {start} + {size} <= m + 1"
    sub = F.expr(f"xxhash64(key, m - y.less, y.i, substring(rest, {start}, {size}))").alias("sub")
    stored = found.where(f"j < {parts}").withColumn("y", F.expr(f"explode(slice(array({tried}), 1, {parts}))"))
    probed = found.withColumn("y", F.expr(f"explode(array({tried}))")).where("y.less = x.less")
    stored, probed = (d.where(fits).select(sub, F.col("h1").alias(name), F.col("n").alias(f"n{name}"), *[F.col(f"c{k}").alias(f"{name}{k}") for k in range(len(COUNTED))]) for d, name in ((stored, "a"), (probed, "b")))
    # two lines of one length find each other, and once is enough
    apart = letters_apart([(f"a{k}", f"b{k}") for k in range(len(COUNTED))])
    met = stored.join(probed, "sub").where("a != b and (a < b or na != nb)").where(f"{apart} <= {2 * edits}")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classify_lines(docs: DataFrame, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text", components: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, dh, n_lines, removed (positions of lines to remove), classes, n_links.

    A line is removed if an equal line, or one within `edits` edits (both of LEAST_CHARS characters or more), stands
    before it: in a document of a smaller id, or higher in its own. Lines are judged on the input, not on what is left.
    Blank lines stay. classes has, for each line, the doc_id of the first of the lines that are equal or linked to it (for
    a line that stays: mostly its own; blank lines: null). n_links is the number of different lines that its lines are
    linked to, over all its lines. Null and empty texts have no lines to remove; rows with a null id stand after all
    others; rows that repeat an id and a text are one document, so all have its result. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lines, near = links(docs, edits)
    both = near.select("a1", "a2", "b1", "b2").union(near.select("b1", "b2", "a1", "a2"))
    other = lines.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("first").alias("other"))
    best = both.join(other, ["b1", "b2"]).groupBy(F.col("a1").alias("h1"), F.col("a2").alias("h2")).agg(F.min("other").alias("near"), F.count("*").alias("links"))
    # only lines that have copies or links need a verdict
    verdict = lines.join(best, ["h1", "h2"], "left").where("copies > 1 or links > 0")
    if components:
        # a vertex is a line by both of its hashes
        vertex = lambda x: F.struct(F.col(f"{x}1").alias("h1"), F.col(f"{x}2").alias("h2"))
        roots = connected_components(near.select(vertex("a").alias("a"), vertex("b").alias("b")))
        roots = through_table(roots.select("vertex.*", "root"), "line-roots")
        named = roots.join(lines, ["h1", "h2"]).groupBy("root").agg(F.min("first").alias("reached"))
        verdict = verdict.join(roots.join(named, "root").select("h1", "h2", "reached"), ["h1", "h2"], "left")
    reached = F.coalesce("reached", "first") if components else F.col("first")
    verdict = through_table(verdict.select("h1", "h2", "first", "near", F.coalesce("links", F.lit(0)).alias("links"), reached.alias("reached")), "line-verdicts")
    judged = line_rows(docs).select("doc_id", "dh", "pos", "h1", "h2").join(broadcast_few(verdict, WIDE_ROWS), ["h1", "h2"]).select(
        "doc_id", "dh", "pos", "links", F.least("first", "near").alias("class"), "reached",
        (F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "dh", "pos") > F.least("first", "near")).alias("gone"),
    ).distinct()
    by_doc = judged.groupBy("doc_id", "dh").agg(
        F.sort_array(F.collect_list(F.when(F.col("gone"), F.col("pos")))).alias("removed"), F.sum("links").alias("n_links"),
        F.map_from_entries(F.collect_list(F.struct("pos", F.col("class.doc_id").alias("class")))).alias("other"),
        *[F.map_from_entries(F.collect_list(F.struct("pos", F.col("reached.doc_id").alias("reached")))).alias("far")] * components,
    ).withColumnsRenamed({"doc_id": "d", "dh": "h"})
    text = F.split("text", "\n", -1)
    own = docs.select("doc_id", F.xxhash64("text").alias("dh"), F.when(F.col("text").isNull(), 0).otherwise(F.size(text)).cast("long").alias("n_lines"), F.transform(text, lambda x: x.rlike("[^\\s]")).alias("solid"))
    found = own.join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("dh") == F.col("h")), "left")
    named = "transform(coalesce(solid, array()), (s, i) -> IF(s, IF(map_contains_key(coalesce({0}, map()), i), {0}[i], doc_id), NULL))"
    classes, more = F.expr(named.format("other")), [F.expr(named.format("far")).alias("components")] * components
    return found.select("doc_id", "dh", "n_lines", F.coalesce("removed", F.expr("array()").cast("array<int>")).alias("removed"), classes.alias("classes"), F.coalesce("n_links", F.lit(0)).alias("n_links"), *more)


def line_components(docs: DataFrame, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of classify_lines, and components: for each line, the doc_id of the first of all lines that it
    reaches over equal lines and links (blank lines: null). Lines that are linked are always of one component.
    """
    return classify_lines(docs, edits, id_col, text_col, components=True)


def remove_lines(docs: DataFrame, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines that classify_lines removes taken out of their texts; all rows and columns stay.

    Null texts stay null, and blank lines stay; of equal lines the first stays (smallest id, then place). Rows that repeat
    an id and a text lose the same lines; rows without an id stand after all others. An empty table gives no rows.
    """
    found = classify_lines(docs, edits, id_col, text_col).where(F.size("removed") > 0)
    gone = through_table(found.groupBy("doc_id", "dh").agg(F.first("removed").alias("__removed")).select(F.col("doc_id").alias("__id"), F.col("dh").alias("__dh"), "__removed"), "line-removed")
    gone = F.broadcast(gone) if gone.select(F.coalesce(F.sum(F.size("__removed") + 6), F.lit(0))).first()[0] <= BROADCAST_ROWS else gone
    met = docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("__dh")), "left")
    left = F.array_join(F.filter(F.split(F.col(f"`{text_col}`"), "\n", -1), lambda x, i: ~F.array_contains(F.col("__removed"), i)), "\n")
    return met.withColumn(text_col, F.when(F.col("__removed").isNull(), F.col(f"`{text_col}`")).otherwise(left)).select(*[f"`{c}`" for c in docs.columns])
