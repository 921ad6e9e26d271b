"""Fuzzy line deduplication, in DataFrame operations only.

Lines are normalised: lower case, anything else than letters, marks and digits as one blank. Lines equal after that, by
128 bits of hash, form a class, which its first occurrence stands for.

A class's fingerprint is a row of 64-bit SimHashes, one for each block of its words: bit by bit, what more than half of
four words have set, the first four of the block in the order of their hashes, words of up to three letters last (most
lines share some of them). The hashes deal the words to the blocks, so a changed word touches the block that it leaves
and the one that it enters at most, and by the pigeonhole principle all others stay equal. How many blocks there are follows the number of distinct words alone: in lines of up to
8 words each word is a block, from 7 to 47 words there are four, from 38 words on eight. Classes meet on all blocks but
one (up to 8 words), on any two of four (up to 23) or on a single block (from 20 on). Two blocks must hold three words, a
single one four.

Where classes meet, each is compared with the place's centre, which is the class that meets the most others over all its
places (of copies of one line with different changes, the least changed); the links found are joined into groups.
While the places where classes of different groups meet hold many pairs, each of their classes is compared with one more
of its place, drawn by hash, and the groups are joined again. Only classes of different groups that still meet then are
compared pair by pair, after their lengths and, if they are compared by word, maps of their words: a word that the other
line hasn't is an edit, so neither bound parts similar lines. So a large group of similar lines costs
a comparison a line, not one a pair, and no link between different groups that meet is lost. Lines of different groups that
share a place and no more still cost a look at both maps a pair. A pair is verified by its edit
similarity, 1 - edits / characters of the longer line (words in lines of over 240 characters), of at least
min_similarity, whatever words it shares. Similar lines that meet nowhere aren't linked: words that all are changed leave no
block of words equal. One occurrence of each connected
group stays: that of the smallest id and, within it, line.

Defined results. Null and empty texts stay as they are. Lines without letter or digit stay. Lines of fewer than three
words go only if another is equal after normalisation. Rows with null id stay as they are and take no part. Rows with
one id are one document: a line at one place goes or stays in all of them. Lines end at a line feed, and one of any
length is worked whole. An empty table gives an empty one. Extra columns are kept; one named like `into` is replaced.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Tables, setting, unused
from ledgerlens.llm.components import components

MIN_SIMILARITY = 0.8
#: All words but one, and two blocks, hold so many distinct words where classes meet on them.
LEAST_WORDS = 3
#: So many words stand for a block; classes meet on a single block that has as many.
BLOCK_WORDS = 4
SHORT_WORD = 3
#: Distinct words of lines that meet on all words but one, on two of four blocks, on one of four and on one of eight. Each range overlaps the next by a fifth.
ALL_BUT_ONE, TWO_OF_FOUR, ONE_OF_FOUR, ONE_OF_EIGHT = (3, 8), (7, 23), (20, 47), (38, 1 << 62)
#: Longer lines are compared word by word, as the time grows with the square of the length. A word is one of SIGNS characters.
LONG_LINE, SIGNS, FIRST_SIGN = 240, 20480, 0x4E00
#: While more pairs a row of a meeting place are left, each class is compared with one more of the place, for so many rounds at most.
PAIRS_A_ROW, MAX_ROUNDS = 4, 3
#: A line's words as so many maps of 64 bits.
MAPS = 8
_LINE_BITS = 4294967296
_NOT_WORDS = r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f[\x{80}-\x{10ffff}&&[^\p{L}\p{M}\p{N}]]]+"
#: A single blank before a word stays as it is.
_ONE_BLANK = r"(?! [a-z0-9[\x{80}-\x{10ffff}&&[\p{L}\p{M}\p{N}]]])"
#: HotSpot runs larger methods uncompiled, which a line's many blocks would make; Spark then generates smaller ones.
_METHOD_BYTES = 8000
#: Joins of partitions of up to so many bytes go by hash, without sorting both sides.
_HASHED_BYTES = 64 << 20


def normalised(text: Column) -> Column:
    """The text, lines normalised but for blanks at either end."""
    return F.regexp_replace(F.lower(text), _ONE_BLANK + _NOT_WORDS, " ")


def word_hash(word: Column) -> Column:
    """Leading bits deal the word to a block; the bit after those of eight blocks puts short words last in theirs."""
    h, last = F.xxhash64(word), 1 << 60
    return F.when(F.length(word) <= SHORT_WORD, h.bitwiseOR(F.lit(last))).otherwise(h.bitwiseAND(F.lit(~last)))


def firsts(n: int) -> list[int]:
    """The least hash of each of n blocks, which leading bits name."""
    return [(i << 64) // n - (1 << 63) for i in range(n)]


def with_blocks(lines: DataFrame, n: int, wanted: Column) -> DataFrame:
    """lines with, for each of n blocks of `hashes`, `n{n}_i`, the number of the words, BLOCK_WORDS at most, that stand for it, and `fp{n}_i`, their SimHash: bit by bit, what more than half of them have set.

    In ascending order a block's words lie behind the least hash that it could hold. Blocks are written out as columns, as generated code costs a small part of what functions over arrays do.
    In a block of three words a fourth has all bits set, in one of two a third, in one of one two others: three of four then are more than half of the words.
    """
    ordered = F.when(wanted, F.sort_array(F.concat("hashes", F.array(*[F.lit(x) for x in firsts(n)]))))
    starts = [F.array_position("__ordered", x).cast("int").alias(f"__at{i}") for i, x in enumerate(firsts(n))]
    placed = lines.withColumn("__ordered", ordered).select("*", *starts, (F.size("__ordered") + 1).alias(f"__at{n}"))
    sized = placed.select("*", *[F.least(F.col(f"__at{i + 1}") - F.col(f"__at{i}") - 1, F.lit(BLOCK_WORDS)).alias(f"n{n}_{i}") for i in range(n)])
    missing = lambda i, k: F.lit(0) if k == 0 else F.when(F.col(f"n{n}_{i}") == 3, -1).otherwise(0) if k == 3 else F.lit(-1)
    word = lambda i, k: F.when(F.col(f"n{n}_{i}") > k, F.get("__ordered", F.col(f"__at{i}") + k)).otherwise(missing(i, k).cast("long")).alias(f"__w{i}_{k}")
    sizes = [f"n{n}_{i}" for i in range(n)]
    named = sized.select(*lines.columns, *sizes, *[word(i, k) for i in range(n) for k in range(BLOCK_WORDS)])

    def simhash(i: int) -> Column:
        x, y, z, u = (F.col(f"__w{i}_{k}") for k in range(BLOCK_WORDS))
        return x.bitwiseAND(y).bitwiseAND(z.bitwiseOR(u)).bitwiseOR(z.bitwiseAND(u).bitwiseAND(x.bitwiseOR(y)))

    return named.select(*lines.columns, *sizes, *[simhash(i).alias(f"fp{n}_{i}") for i in range(n)])


def all_but_one(hashes: Column) -> Column:
    """A place for all words and for all but each one."""
    less = F.transform(F.sequence(F.lit(1), F.size(hashes)), lambda i: F.concat(F.slice(hashes, F.lit(1), i - 1), F.slice(hashes, i + 1, F.size(hashes))))
    return F.transform(F.filter(F.concat(F.array(hashes), less), lambda x: F.size(x) >= LEAST_WORDS), lambda x: F.xxhash64(x))


def with_places(lines: DataFrame) -> DataFrame:
    """lines with `places`, hashes of where each meets similar ones. lines: words, an array, and others."""
    columns, n = [c for c in lines.columns if c != "words"], F.size("hashes")
    hashed = lines.select(*columns, F.array_distinct(F.transform("words", word_hash)).alias("hashes"))
    marked = with_blocks(with_blocks(hashed, 4, n.between(TWO_OF_FOUR[0], ONE_OF_FOUR[1])), 8, n.between(*ONE_OF_EIGHT))
    two = [F.when(n.between(*TWO_OF_FOUR) & (F.col(f"n4_{i}") + F.col(f"n4_{j}") >= LEAST_WORDS), F.xxhash64(F.lit(10 * i + j), f"fp4_{i}", f"fp4_{j}")) for i, j in combinations(range(4), 2)]
    single = lambda k, least, most: [F.when(n.between(least, most) & (F.col(f"n{k}_{i}") == BLOCK_WORDS), F.xxhash64(F.lit(f"of{k}"), F.lit(i), f"fp{k}_{i}")) for i in range(k)]
    met = F.array(*two, *single(4, *ONE_OF_FOUR), *single(8, *ONE_OF_EIGHT))
    short = F.when(n.between(*ALL_BUT_ONE), all_but_one(F.sort_array("hashes"))).otherwise(F.array().cast("array<long>"))
    return marked.select(*columns, F.array_except(F.concat(short, met), F.array(F.lit(None).cast("long"))).alias("places"))  # distinct ones, no nulls


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, two hashes of the normalised line, its characters and words and its places, of every line that has words. docs: doc_id, text."""
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split(normalised(F.col("text")), "\n")).alias("line_no", "line"))
    found = lines.select("doc_id", "line_no", F.trim("line").alias("norm")).where("norm <> ''")
    words = F.split("norm", " ")
    named = found.select("doc_id", "line_no", F.xxhash64("norm").alias("h1"), F.xxhash64("norm", F.lit(1)).alias("h2"), F.length("norm").alias("chars"), words.alias("words"))
    return with_places(named.withColumn("n_words", F.size("words"))).select("doc_id", "line_no", "h1", "h2", "chars", F.col("n_words").alias("words"), "places")


def position(doc_id: str = "doc_id", line_no: str = "line_no") -> Column:
    """A number that orders lines by document and line."""
    return (F.col(doc_id).cast("decimal(20,0)") * F.lit(_LINE_BITS).cast("decimal(10,0)") + F.col(line_no).cast("decimal(10,0)")).cast("decimal(38,0)")


def place_of(pos: str = "pos") -> tuple[Column, Column]:
    """doc_id and line_no of a position."""
    line_no = F.pmod(F.col(pos), F.lit(_LINE_BITS).cast("decimal(10,0)"))
    return F.expr(f"({pos} - pmod({pos}, {_LINE_BITS})) div {_LINE_BITS}").cast("long").alias("doc_id"), line_no.cast("int").alias("line_no")


def coded(norm: Column) -> Column:
    """A line with each word as one character, a hash of it."""
    sign = lambda w: F.hex(F.pmod(F.xxhash64(w), F.lit(SIGNS)) + FIRST_SIGN)
    return F.decode(F.unhex(F.array_join(F.transform(F.split(norm, " "), sign), "")), "UTF-16BE")


def within(a: Column, b: Column, min_similarity: float) -> Column:
    """Edit similarity of at least min_similarity. Few edits are looked for first, since a narrow band costs less."""
    longer = F.greatest(F.length(a), F.length(b))
    most = F.floor(longer * F.lit(1 - min_similarity) + F.lit(1e-9)).cast("int")
    found = lambda part: F.call_function("levenshtein", a, b, F.floor(most / part).cast("int")) >= 0
    return (F.abs(F.length(a) - F.length(b)) <= most) & (found(64) | found(16) | found(4) | found(1))


def similar(a: Column, b: Column, coded_a: Column, coded_b: Column, min_similarity: float) -> Column:
    """Edit similarity of at least min_similarity, by character or, if one has more than LONG_LINE characters (and is null here), by word."""
    return F.when(a.isNull() | b.isNull(), within(coded_a, coded_b, min_similarity)).otherwise(within(a, b, min_similarity))


def verified(pairs: DataFrame, texts: DataFrame, min_similarity: float) -> DataFrame:
    """The pairs of classes h_a, h_b, named by h1, whose lines are similar, with their positions a < b. texts: h1, pos, norm, coded."""
    one, two = (texts.select(F.col("h1").alias(f"h_{k}"), F.col("pos").alias(k), F.col("norm").alias(f"norm_{k}"), F.col("coded").alias(f"coded_{k}")) for k in "ab")
    both = pairs.join(one, "h_a").join(two, "h_b").where(F.col("a") != F.col("b"))
    both = both.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # the work grows with the pairs, not with their bytes
    others = [c for c in pairs.columns if c not in ("h_a", "h_b")]
    return both.where(similar(*(F.col(x) for x in ("norm_a", "norm_b", "coded_a", "coded_b")), min_similarity)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *others)


def class_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """h1, pos, norm (null over LONG_LINE characters), coded of classes, from the lines that stand for them. docs: doc_id, text; wanted: h1, pos."""
    by_doc = wanted.select(*place_of(), F.struct("h1", "pos", place_of()[1]).alias("w")).groupBy("doc_id").agg(F.collect_list("w").alias("ws"))
    line = lambda lines, w: F.struct(w["h1"].alias("h1"), w["pos"].alias("pos"), F.trim(normalised(F.get(lines, w["line_no"]))).alias("norm"))
    found = F.get(F.transform(F.array(F.split("text", "\n")), lambda lines: F.transform("ws", lambda w: line(lines, w))), 0)
    lines = docs.where("text is not null").join(by_doc.hint("shuffle_hash"), "doc_id").select(F.inline(found)).where(F.xxhash64("norm") == F.col("h1"))
    short = F.when(F.length("norm") <= LONG_LINE, F.col("norm"))
    return lines.select("h1", "pos", short.alias("norm"), coded(F.col("norm")).alias("coded")).groupBy("h1", "pos").agg(F.min("norm").alias("norm"), F.min("coded").alias("coded"))


def still_open(named: DataFrame) -> DataFrame:
    """The rows of places where classes of different groups meet. named: place, h1, component and others."""
    rows = named.repartition("place")
    apart = rows.groupBy("place").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("place")
    return rows.join(apart.hint("shuffle_hash"), "place")


def word_maps(texts: DataFrame) -> DataFrame:
    """h1, maps: for each of MAPS a long, in which each distinct word sets a bit. texts: h1, coded."""
    words = F.transform(F.array_distinct(F.split("coded", "")), lambda x: F.ascii(x))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x, 3).bitwiseAND(63))
    one = lambda k: F.aggregate("words", F.lit(0).cast("long"), lambda found, x: F.when(x.bitwiseAND(MAPS - 1) == k, found.bitwiseOR(bit(x))).otherwise(found)).alias(f"m{k}")
    return texts.select("h1", words.alias("words")).select("h1", F.struct(*[one(k) for k in range(MAPS)]).alias("maps"))


def pairs_left(open_: DataFrame) -> tuple[int, int]:
    """Rows of open places, and pairs of classes of different groups in them."""
    sizes = open_.groupBy("place", "component").agg(F.count("*").alias("n")).groupBy("place").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("same"))
    found = sizes.agg(F.sum("rows"), F.sum((F.col("rows") * F.col("rows") - F.col("same")) / 2)).first()
    return found[0] or 0, found[1] or 0


def may_match(one: Column, two: Column, min_similarity: float, maps: bool = False) -> Column:
    """Whether the lengths of two lines leave room for similarity, and the maps of words of those compared by word: a word more, or one that the other hasn't, is an edit."""
    most = lambda x: F.greatest(one[x], two[x]) * F.lit(1 - min_similarity) + F.lit(1e-9)
    near = lambda x: F.abs(one[x] - two[x]) <= most(x)
    lacking = lambda a, b: sum((F.bit_count(a["maps"][f"m{k}"].bitwiseAND(F.bitwise_not(b["maps"][f"m{k}"]))) for k in range(MAPS)), F.lit(0))
    words = near("words") & (lacking(one, two) <= most("words")) & (lacking(two, one) <= most("words")) if maps else near("words")
    return F.when(F.greatest(one["chars"], two["chars"]) > LONG_LINE, words).otherwise(near("chars"))


def paired(one: Column, two: Column) -> list[Column]:
    """Columns h_a, h_b, c_a, c_b of two structs of h1 and component."""
    low, high = F.least(one, two), F.greatest(one, two)
    return [low["h1"].alias("h_a"), high["h1"].alias("h_b"), low["component"].alias("c_a"), high["component"].alias("c_b")]


def groups(docs: DataFrame, classes: DataFrame, min_similarity: float, tables: Tables) -> DataFrame:
    """node, component: the group of every class that is near another, by position. docs: doc_id, text; classes: h1, pos, places."""
    rows = classes.select(F.explode("places").alias("place"), "h1", F.shiftleft(F.col("chars").cast("long"), 32).bitwiseOR(F.col("words")).alias("both")).repartition("place")
    sizes = rows.groupBy("place").agg(F.count("*").alias("n"), F.min("h1").alias("first"), F.max("h1").alias("last")).where("first < last").select("place", "n")
    unpacked = F.shiftright("both", 32).cast("int").alias("chars"), F.col("both").bitwiseAND((1 << 32) - 1).cast("int").alias("words")
    met = tables.store("met", rows.join(sizes.hint("shuffle_hash"), "place").select("place", "h1", *unpacked, "n"))
    central = met.groupBy("h1").agg(F.sum("n").alias("weight"))
    centres = met.select("place", "h1", "chars", "words").join(central, "h1").groupBy("place").agg(F.max(F.struct("weight", "h1", "chars", "words")).alias("x"))
    members = met.select("h1").distinct()
    texts = tables.store("texts", class_texts(docs, classes.select("h1", "pos").join(members, "h1", "left_semi")))
    star = met.join(centres, "place").where((F.col("x.h1") != F.col("h1")) & may_match(F.struct("chars", "words"), F.col("x"), min_similarity)).select(F.least("x.h1", "h1").alias("h_a"), F.greatest("x.h1", "h1").alias("h_b")).distinct()
    star = tables.store("star", star)
    links = tables.store("links", verified(star, texts, min_similarity))
    found = tables.store("found", components(links))
    edges, used = found.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")), ["links", "found"]
    named = texts.select("h1", "pos").join(found, F.col("pos") == F.col("node"), "left").select("h1", F.coalesce("component", "pos").alias("component"))
    wide = tables.store("wide", still_open(met.join(named, "h1").select("place", "h1", "component", "chars", "words")))
    open_ = tables.store("open", wide.join(word_maps(texts.join(wide.select("h1").distinct(), "h1", "left_semi")), "h1"))
    tables.drop("wide")
    member = F.struct("h1", "component", "chars", "words", "maps")
    for step in range(MAX_ROUNDS):
        n, left = pairs_left(open_)
        if left <= PAIRS_A_ROW * n:
            break
        chosen = open_.groupBy("place").agg(F.min_by(member, F.xxhash64("h1", F.lit(step))).alias("x"))
        pairs = open_.join(chosen, "place").where((F.col("component") != F.col("x.component")) & may_match(member, F.col("x"), min_similarity, maps=True)).select(*paired(member, F.col("x"))).distinct()
        near = tables.store(f"near{step}", verified(pairs, texts, min_similarity).select(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b")).distinct())
        used.append(f"near{step}")
        edges = edges.unionByName(near)
        if near.isEmpty():
            break
        joined = tables.store(f"joined{step}", components(near))
        renamed = open_.join(joined.withColumnRenamed("component", "new"), F.col("component") == F.col("node"), "left")
        before, open_ = tables.paths.pop("open"), tables.store("open", still_open(renamed.select("place", "h1", F.coalesce("new", "component").alias("component"), "chars", "words", "maps")))
        tables.paths[f"open{step}"] = before
        tables.drop(f"open{step}", f"joined{step}")
    at = open_.groupBy("h1").agg(F.collect_set("place").alias("at"))
    one, two = (open_.join(at, "h1").select("place", member.alias(k), F.col("at").alias(f"at_{k}")) for k in "xy")
    once = F.array_min(F.array_intersect("at_x", "at_y")) == F.col("place")  # a pair that meets at many places is made at one
    rest = one.join(two, "place").where((F.col("x.component") < F.col("y.component")) & may_match(F.col("x"), F.col("y"), min_similarity, maps=True) & once)
    rest = rest.select(*paired(F.col("x"), F.col("y"))).select("h_a", "h_b").distinct().join(star, ["h_a", "h_b"], "left_anti")
    more = tables.store("more", verified(rest, texts, min_similarity))
    tables.drop("met", "star", "open", "texts")
    out = tables.store("groups", components(edges.unionByName(more)))
    tables.drop(*used, "more")
    return out


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """doc_id, lines: the numbers (from 0) of the lines that go, for documents that lose any."""
    with setting(docs.sparkSession, "spark.sql.codegen.hugeMethodLimit", _METHOD_BYTES), setting(docs.sparkSession, "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", _HASHED_BYTES):
        return _repeated_lines(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")), min_similarity, Tables(docs.sparkSession))


def _repeated_lines(docs: DataFrame, min_similarity: float, tables: Tables) -> DataFrame:
    lines = tables.store("lines", line_rows(docs))
    classes = tables.store("classes", lines.groupBy("h1", "h2", "chars", "words", "places").agg(F.count("*").alias("n"), F.min(position()).alias("pos")))
    named = classes.select("h1", "h2", "n", "pos").join(groups(docs, classes, min_similarity, tables), F.col("pos") == F.col("node"), "left")
    kept = named.select("h1", "h2", "n", "pos", F.coalesce("component", "pos").alias("kept_pos")).where("n > 1 or pos <> kept_pos").select("h1", "h2", "kept_pos")
    gone = lines.select("doc_id", "line_no", "h1", "h2").join(kept, ["h1", "h2"]).where(position() != F.col("kept_pos"))
    out = tables.store("gone", gone.groupBy("doc_id").agg(F.collect_set("line_no").alias("lines")))
    tables.drop("lines", "classes", "groups")
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", into: str | None = None, **options) -> DataFrame:
    """docs with repeated lines taken out of the text; `into` names a column for the numbers of the lines that went."""
    found, own = unused(docs, "__id"), unused(docs, "__gone")
    gone = repeated_lines(docs, id_col, text, **options).select(F.col("doc_id").alias(found), F.col("lines").alias(own)).hint("shuffle_hash")
    both = docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(found), "left")
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(own))
    joined = F.transform(F.array(F.split(F.col(f"`{text}`"), "\n")), lambda lines: F.array_join(F.transform(left(lines), lambda i: F.get(lines, i)), "\n"))  # a text is split once
    new = F.when(F.col(own).isNull(), F.col(f"`{text}`")).otherwise(F.get(joined, 0))
    out = [new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c != into]
    if into:
        out.append(F.coalesce(own, F.array().cast("array<int>")).alias(into))
    return both.select(*out)
