"""Line dedup by a segment-partition edit join, in DataFrame and SQL functions only.

Lines within ``errors`` edits of each other share, at a nearly equal place, one of the ``errors + 1`` segments that the
shorter of the two is split into. So every line posts its segments under (length, segment, content), and probes, for each
length it may match, the few substrings that can be such a segment. Lines that meet under a key are candidates. Under
each key all lines are first compared with the smallest one; afterwards only lines that are still in different groups are
paired, and only if parities of their character pairs allow ``errors`` edits, so a frequent segment never yields all its pairs. Candidates
are verified by the banded bit-parallel edit distance. Linked lines form classes, and of each class the first line in
the corpus stays; exact copies of a line are one line throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from driftline.llm.common import Stages, boxed, field
from driftline.llm.graph import components
from driftline.store import lookup

ERRORS, MIN_CHARS = 2, 20
#: Characters of a segment that its key tells.
HEAD = 40


def segment(length: Column, number: int | Column, errors: int) -> tuple[Column, Column]:
    """Start (from 0) and length of a segment of a line; the last segments take the remainder."""
    parts = errors + 1
    base, longer = F.floor(length / parts), length % parts
    extra = F.greatest(F.lit(number) - (parts - longer), F.lit(0))
    return base * number + extra, base + F.when(number >= parts - longer, 1).otherwise(0)


def shifts(number: int, shorter: int, errors: int) -> range:
    """How far segment ``number`` of a line that is ``shorter`` characters shorter may have moved."""
    return range(max(-number, shorter - (errors - number)), min(number, shorter + (errors - number)) + 1)


def windows(line: Column, errors: int) -> list[Column]:
    """For each segment the stretch of the line that holds the heads of all its keys, so that each line is walked once."""
    length, out = F.char_length(line), []
    for number in range(errors + 1):
        first = segment(length - errors, number, errors)[0] - number
        out.append(F.substring(line, (first + 1).cast("int"), F.lit(HEAD + 3 * errors + number)).alias(f"part{number}"))
    return out


def keys(lines: DataFrame, errors: int) -> DataFrame:
    """(h, key, posted): posted and probed keys of each line.

    A key is the length of the shorter line, the segment, and the head of its content. One expression serves all cases,
    which are numbers in rows: written out case by case, the generated method passes the 8,000 bytes up to which the JVM
    compiles it, and every line is interpreted.
    """
    numbers = range(errors + 1)
    cases = [(shorter, number, shift) for shorter in numbers for number in numbers for shift in shifts(number, shorter, errors)]
    table = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("shorter", "number", "shift"), case)]) for case in cases])
    parts = lines.select("h", F.char_length("line").alias("length"), *windows(F.col("line"), errors))
    rows = parts.select("*", F.inline(table))
    length, number = F.col("length") - F.col("shorter"), F.col("number")
    at, size = segment(length, number, errors)
    first = segment(F.col("length") - errors, number, errors)[0] - number
    part = F.coalesce(*[F.when(number == x, F.col(f"part{x}")) for x in numbers])
    content = F.substring(part, (at + F.col("shift") - first + 1).cast("int"), F.least(size, F.lit(HEAD)).cast("int"))
    posted = (F.col("shorter") == 0) & (F.col("shift") == 0)
    return rows.select("h", F.xxhash64(length, number, content).alias("key"), posted.alias("posted"))


def parity(line: str) -> Column:
    """Twice 64 parities of how often the character pairs of a line fall into each of 64 bins. One edit changes four
    pairs at most, so lines within ``errors`` edits differ in at most four times as many bits."""
    return F.expr(f"""
    transform(array(split(concat('\n', {line}, '\n'), '')), c ->
      aggregate(sequence(1, size(c) - 1), named_struct('w0', 0L, 'w1', 0L), (s, i) ->
        transform(array(xxhash64(c[i - 1], c[i])), x -> named_struct(
          'w0', s.w0 ^ shiftleft(1L, cast(x & 63 as int)),
          'w1', s.w1 ^ shiftleft(1L, cast(shiftright(x, 6) & 63 as int))))[0]))[0]""")


def edit_distance_within(a: str, b: str, errors: int) -> Column:
    """Whether the edit distance of two columns is at most ``errors``, by bit vectors of the band around the diagonal.

    Bit ``i`` of column ``j`` stands for row ``j - errors + i``. The distance is followed down the lower edge of the band
    to the last row and then along that row. Both lines must be longer than ``errors``. Once the distance cannot come
    back under the bound, the rest of the line is passed over.
    """
    width = 2 * errors + 1
    full = (1 << width) - 1
    low_edge = 1 << (width - 1)
    start = (full << errors) & full
    match = " + ".join(f"if(get(p.a, j - 1 + {k - errors}) <=> p.c, {1 << k}L, 0L)" for k in range(width))
    step = f"""
      transform(array(named_struct('a', a, 'c', get(b, j - 1))), p -> {match})[0]"""
    diagonal = f"(((((x & s.vp) + s.vp) & {full}L) ^ s.vp) | x | s.vn)"
    text = f"""
    transform(array(named_struct('a', split({a}, ''), 'b', split({b}, ''))), l ->
      aggregate(sequence(1, size(l.b)), named_struct('vp', {start}L, 'vn', 0L, 'd', {errors}), (s, j) ->
        if(s.d > {2 * errors} + size(l.b) - size(l.a), s,
          transform(array({step.replace("'a', a,", "'a', l.a,").replace("get(b,", "get(l.b,")}), x ->
            transform(array({diagonal}), d ->
              transform(array(named_struct('hp', (s.vn | ~(d | s.vp)) & {full}L, 'hn', d & s.vp)), h ->
                named_struct(
                  'vp', (h.hn | ~(shiftright(d, 1) | h.hp)) & {full}L,
                  'vn', shiftright(d, 1) & h.hp,
                  'd', s.d + if(j + {errors} <= size(l.a), if(d & {low_edge}L = 0, 1, 0),
                    if(h.hp & shiftleft(1L, size(l.a) - j + {errors}) <> 0, 1, 0) - if(h.hn & shiftleft(1L, size(l.a) - j + {errors}) <> 0, 1, 0)))
              )[0])[0])[0]),
        s -> s.d <= {errors} and abs(size(l.a) - size(l.b)) <= {errors}))[0]"""
    return F.expr(text)


def _lines(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """Lines long enough to be compared: owner (key and text hash), place, line and its identity."""
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("print"), F.posexplode(F.split(F.col(text), "\n")).alias("place", "line"))
    return rows.where(F.char_length("line") >= least).select("id", "print", "place", "line", F.xxhash64("line").alias("h"), F.hash("line").alias("proof"))


def line_links(lines: DataFrame, errors: int, stages: Stages) -> DataFrame:
    """(a, b): verified links between different lines, enough to connect all lines that links connect."""
    posted = keys(lines, errors).repartition("key")
    # keys under which only one line is found go, in the partition that holds the key
    met = posted.groupBy("key").agg(F.min("h").alias("hub"), F.max("h").alias("top"), F.max("posted").alias("used")).where("hub < top and used")
    found = posted.join(met.select("key", "hub").hint("shuffle_hash"), "key").groupBy("key", "hub", "h").agg(F.max("posted").alias("posted"))
    live = stages.write(found)

    wanted = lookup(live.select("h").distinct())
    texts = lines.join(wanted, "h", "left_semi").groupBy("h").agg(F.first("line").alias("line"))
    texts = stages.write(texts.withColumn("w", parity("line")).select("h", "line", "w.w0", "w.w1"))

    def side(name: str) -> DataFrame:
        return texts.select(*[F.col(c).alias(f"{name}_{c}" if c != "h" else name) for c in texts.columns])

    def apart(name: str) -> Column:
        return F.bit_count(F.col(f"a_{name}").bitwiseXOR(F.col(f"b_{name}")))

    alike = (apart("w0") <= 4 * errors) & (apart("w1") <= 4 * errors)
    near = alike & (F.abs(F.char_length("a_line") - F.char_length("b_line")) <= errors)

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side("a"), "a").join(side("b"), "b").where(near)
        return stages.write(both.where(edit_distance_within("a_line", "b_line", errors)).select("a", "b"))

    star = verified(live.where("h <> hub").select(F.col("hub").alias("a"), F.col("h").alias("b")).distinct())
    group = components(star, "a", "b", stages).withColumnRenamed("node", "h")
    rest = live.where("h <> hub").join(texts.select("h", "w0", "w1"), "h").join(group, "h", "left").withColumn("root", F.coalesce("root", "h"))
    left = rest.where("posted").select("key", *[F.col(c).alias(f"a_{c}") for c in ("h", "w0", "w1", "root")])
    right = rest.select("key", *[F.col(c).alias(f"b_{c}") for c in ("h", "w0", "w1", "root")])
    pairs = left.join(right, (left["key"] == right["key"]) & (F.col("a_root") != F.col("b_root")) & alike)
    return star.unionAll(verified(pairs.select(F.least("a_h", "b_h").alias("a"), F.greatest("a_h", "b_h").alias("b")).distinct()))


def kept_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", errors: int = ERRORS, least: int = MIN_CHARS) -> DataFrame:
    """(id, print, kept): per document that has some, the places of the long lines that stay."""
    stages = Stages(docs.sparkSession)
    lines = _lines(docs, key, text, least)
    place = F.struct(F.col("id").isNull().alias("last"), "id", "print", "place")
    first = stages.write(lines.groupBy("h", "proof").agg(F.min(place).alias("first")))
    roots = components(line_links(lines, errors, stages), "a", "b", stages)
    # a class without links is its line alone; the others are few rows
    joined = first.join(roots, first["h"] == roots["node"], "left")
    lone = joined.where("root is null").select("first")
    best = joined.where("root is not null").groupBy("root").agg(F.min("first").alias("first")).select("first")
    return lone.unionAll(best).groupBy("first.id", "first.print").agg(F.array_sort(F.collect_list("first.place")).alias("kept"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", errors: int = ERRORS, least: int = MIN_CHARS) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and (n_lines, n_removed) as struct ``line_dedup``.

    Lines of at least ``least`` characters within ``errors`` edits of each other, directly or by a chain, are one class;
    only its first line by (key, place) stays. Shorter lines stay. Null and empty texts stay as they are. A null key
    comes after all others. Rows that repeat key and text count as one document and get the same result. An empty table
    gives no rows; other columns, whatever their names, pass through, but for one called ``line_dedup``, which is replaced.
    """
    kept = kept_lines(docs, key, text, errors, least)
    rows = boxed(docs).withColumn("mark", F.xxhash64(field(text)))
    joined = rows.join(kept, field(key).eqNullSafe(F.col("id")) & (F.col("mark") == F.col("print")), "left")
    gaps = F.expr("transform(kept, (x, i) -> x - if(i = 0, -1, kept[i - 1]) - 1)")
    flags = F.flatten(F.transform(gaps, lambda gap: F.concat(F.array_repeat(F.lit(False), gap), F.array(F.lit(True)))))
    # inline works each row out once; a plain select would be copied into every condition on the report
    parts = F.array(F.struct(F.split(field(text), "\n").alias("lines"), F.coalesce(flags, F.array().cast("array<boolean>")).alias("flags")))

    def stay(part: Column) -> Column:
        return F.filter(part["lines"], lambda line, i: (F.char_length(line) < least) | F.coalesce(F.get(part["flags"], i), F.lit(False)))

    out = joined.select("box", F.inline(F.transform(parts, lambda part: F.struct(part["lines"].alias("lines"), stay(part).alias("stay")))))
    total, left = F.size("lines").cast("long"), F.size("stay").cast("long")
    there = field(text).isNotNull()
    report = F.struct(F.when(there, total).otherwise(0).alias("n_lines"), F.when(there, total - left).otherwise(0).alias("n_removed"))
    return out.select(
        *[F.when(there, F.concat_ws("\n", "stay")).alias(text) if c == text else field(c).alias(c) for c in docs.columns if c != "line_dedup"],
        report.alias("line_dedup"),
    )
