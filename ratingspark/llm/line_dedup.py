"""Line deduplication with a log-template tree, in DataFrame functions alone.

A line's words (fields with a digit count as ``<*>``) lead through a tree of
fixed depth: the number of words, then the ``DEPTH`` leading words. In a leaf,
a word is constant at its place if at least ``MIN_DOCS`` distinct lines of
different documents hold it there; any other word generalises to ``<*>``. The
outcome is the line's template, valid if ``CONSTANT`` of its fields are
constant. A valid template in at least ``MIN_DOCS`` documents recurs: its
lines are dropped, but for the first by (document id, place), so that nothing
is lost from the corpus altogether (``keep_first=False`` drops that as well).

Documents with equal texts count as one. A document with ``COPY_SHARE`` or
more of its words in recurring lines is a copy of others rather than a carrier
of boilerplate; it stays whole, for near-deduplication to judge. With
``verified`` (the pipeline) the share is not enough: only a text of which
another holds the same recurring passages, so that their ``WIDTH``-word
shingles are similar by ``NEAR`` or more, stays whole.

Exact recurring lines are their own templates: of these only one row per
distinct line is taken apart. No leaf, template or document group meets in one
task: all counts combine before the shuffle, all joins are plain equi-joins of
written tables, which Spark can split where a key is hot.

Defined cases: a null text stays null with 0 lines; an empty text has one
empty line; lines of fewer than ``MIN_TOKENS`` words are never dropped, unless
``short`` (the pipeline) lets exact recurring lines of any non-zero length count
and takes each character of a script without spaces as a word;
repeated rows get equal results; a null id comes first in the order; other
columns are kept; an empty table gives no rows. Texts of any length are read
whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingspark.llm.common import split_by, thinned, written

DEPTH, MIN_TOKENS, MIN_DOCS = 3, 4, 3
CONSTANT, COPY_SHARE = 0.7, 0.8
#: Shingles and similarity of the near-duplicate stage.
WIDTH, NEAR = 5, 0.8
FIELD = "<*>"
#: Characters, with their marks, of scripts that are written without spaces.
UNSPACED = (r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]"
            r"\p{M}*")


def _plain_words(line: str, short: bool) -> Column:
    text = F.regexp_replace(F.col(line), UNSPACED, " $0 ") if short else F.col(line)
    return F.filter(F.split(text, r"[ \t\r\f\x0B]+"), lambda w: w != "")


def _words(line: str, short: bool = False) -> Column:
    """The words of a line, fields with a digit as ``<*>``."""
    split = _plain_words(line, short)
    masked = F.transform(split, lambda w: F.when(w.rlike("[0-9]"), FIELD).otherwise(w))
    return F.when(F.col(line).rlike("[0-9]"), masked).otherwise(split)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with a 128-bit name of their text."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("t1"),
                       F.xxhash64(F.lit(7), text).alias("t2"))


def _near_copies(texts: DataFrame, found: DataFrame, copies: DataFrame) -> DataFrame:
    """``t1, t2`` of the texts among ``copies`` that have a near copy with the
    same recurring passages. With X the shingles inside these passages, and a
    and b those besides of the two texts, the similarity is at least
    X / (X + a + b): no pair of texts meets, each is held against the one of
    its group with the fewest shingles besides."""
    def shingles(words: str) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(words) - (WIDTH - 1), F.lit(1)))
        runs = F.filter(F.transform(at, lambda k: F.slice(words, k, WIDTH)),
                        lambda run: (F.size(run) == WIDTH) & ~F.exists(run, lambda w: w == ""))
        return F.array_sort(F.array_distinct(F.transform(runs, lambda run: F.xxhash64(run))))

    places = found.join(copies, ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.collect_set("place").alias("places"))
    text = thinned(texts.select("t1", "t2", "text"), "t1", copies).dropDuplicates(["t1", "t2"]).join(places, ["t1", "t2"])
    own = F.transform(F.split("text", "\n"), lambda line: F.filter(
        F.split(F.lower(line), r"[ \t\r\f\x0B]+"), lambda w: w != ""))
    # a line that does not recur is a gap: the empty word
    gapped = F.transform("lines", lambda line, k: F.when(
        (F.size(line) == 0) | F.array_contains("places", k), line).otherwise(F.array(F.lit(""))))
    sets = (text.withColumn("lines", own)
            .select("t1", "t2", F.flatten("lines").alias("all"), F.flatten(gapped).alias("again"))
            .select("t1", "t2", F.size(shingles("all")).alias("n"), shingles("again").alias("x")))
    besides = F.col("n") - F.size("x")
    sized = written(sets.where(F.size("x") > 0).select(
        "t1", "t2", F.size("x").alias("shared"), besides.alias("besides"), F.xxhash64("x").alias("x1"),
        F.xxhash64(F.lit(7), "x").alias("x2")), "copy-shingles")
    least = sized.groupBy("x1", "x2").agg(F.min(F.struct("besides", "t1", "t2")).alias("least"))
    near = written(sized.join(least, ["x1", "x2"]).where(
        ((F.col("t1") != F.col("least.t1")) | (F.col("t2") != F.col("least.t2")))
        & (F.col("shared") >= NEAR * (F.col("shared") + F.col("besides") + F.col("least.besides"))))
        .select("t1", "t2", F.col("least.t1").alias("l1"), F.col("least.t2").alias("l2")), "near-copies")
    return near.select("t1", "t2").unionByName(near.select(F.col("l1").alias("t1"), F.col("l2").alias("t2"))).distinct()


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
                    keep_first: bool = True, verified: bool = False,
                    short: bool = False) -> DataFrame:
    """Of every distinct text with lines to drop: its name ``t1, t2`` and
    ``places``, the 0-based numbers of those lines."""
    texts = _keyed(docs, id_col, text_col).where("text is not null")
    cut = (texts.select("id", "t1", "t2", F.posexplode(F.split("text", "\n")).alias("place", "line"))
           .select("id", "t1", "t2", "place", "line", _words("line", short).alias("words")))
    name = F.xxhash64(F.size("words"), "words")
    if short:  # a short line is its own template as it stands, with its digits
        name = F.when(F.size("words") >= MIN_TOKENS, name).otherwise(
            F.xxhash64(F.lit("short"), _plain_words("line", short)))
    skinny = written(cut.select(
        "id", "t1", "t2", "place", F.size("words").alias("n"),
        F.xxhash64(F.size("words"), F.slice("words", 1, DEPTH)).alias("leaf"),
        name.alias("line")), "lines")
    lines = skinny.where(F.col("n") >= (1 if short else MIN_TOKENS))

    # (leaf, line) pairs with the number of texts that hold them
    in_texts = lines.select("leaf", "line", "n", "t1", "t2").distinct()
    kinds = written(in_texts.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("texts"), F.max("n").alias("n")),
                    "kinds")
    exact = written(kinds.where(F.col("texts") >= min_docs).select(
        "leaf", "line", "texts", F.col("line").alias("template")), "exact-templates")
    # leaves where other lines could share a template: enough of them, or of any lines together
    long = kinds.where(F.col("n") >= MIN_TOKENS)
    leaves = written(long.groupBy("leaf").agg(
        F.sum("texts").alias("texts"), F.sum(F.when(F.col("texts") < min_docs, F.col("texts"))).alias("rare"))
        .where((F.col("rare") >= min_docs) & (F.col("texts") >= min_docs)).select("leaf"), "leaves")
    rare = long.where(F.col("texts") < min_docs).join(leaves, "leaf", "left_semi")
    known = long.where(F.col("texts") >= min_docs).join(leaves, "leaf", "left_semi")
    wanted = written(rare.unionByName(known).select("leaf", "line", "texts"), "wanted-lines")

    # the words of one holder of each wanted line; bitmaps keep the other lines out of the shuffle
    spot = F.xxhash64("t1", "t2", "place")
    holder = written(lines.join(wanted, ["leaf", "line"]).groupBy("leaf", "line", "texts")
                     .agg(F.min(F.struct("t1", "t2", "place")).alias("at"))
                     .select("leaf", "line", "texts", "at.*").withColumn("spot", spot), "holders")
    contents = (thinned(texts.select("t1", "t2", "text"), "t1", holder)
                .select("t1", "t2", F.posexplode(F.split("text", "\n")).alias("place", "content")).withColumn("spot", spot))
    contents = thinned(contents, "spot", holder).dropDuplicates(["t1", "t2", "place"]).drop("spot")
    taken = contents.join(holder, ["t1", "t2", "place"]).select("leaf", "line", "texts", "content")
    words = written(taken.select("leaf", "line", "texts", F.posexplode(F.transform(
        _words("content", short), lambda w: F.when(w != FIELD, F.xxhash64(w)))).alias("at", "word")), "words")
    constant = written(words.where("word is not null").groupBy("leaf", "at", "word")
                       .agg(F.sum("texts").alias("texts")).where(F.col("texts") >= min_docs)
                       .select("leaf", "at", "word"), "constants")
    parts = (words.where(F.col("texts") < min_docs)
             .join(constant.withColumn("fixed", F.lit(True)), ["leaf", "at", "word"], "left"))
    # a template's name: the sum of its constant fields' hashes
    shaped = (parts.groupBy("leaf", "line", "texts").agg(
        F.count(F.lit(1)).alias("n"), F.count("fixed").alias("n_fixed"),
        F.sum(F.when(F.col("fixed"), F.xxhash64("at", "word").cast("decimal(20,0)"))).alias("name"))
        .where(F.col("n_fixed") >= CONSTANT * F.col("n"))
        .select("leaf", "line", F.xxhash64("leaf", "n_fixed", "name").alias("template")))
    general = written(shaped, "templates")
    held = (lines.join(general, ["leaf", "line"]).select("template", "t1", "t2").distinct()
            .groupBy("template").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= min_docs))
    named = written(general.join(held.select("template"), "template", "left_semi").select("leaf", "line", "template")
                    .unionByName(exact.select("leaf", "line", "template")), "recurring")

    found = written(lines.join(named, ["leaf", "line"]).select("id", "t1", "t2", "place", "n", "template"), "found")
    first = written(found.groupBy("template").agg(F.min(F.struct(
        F.col("id").isNotNull().alias("known"), "id", "t1", "t2", "place")).alias("first")), "first")
    # by text: words in all, words in recurring lines
    in_all = skinny.select("t1", "t2", "place", "n").distinct().groupBy("t1", "t2").agg(F.sum("n").alias("words"))
    per_text = found.select("t1", "t2", "place", "n", "template").distinct()
    copies = written(per_text.groupBy("t1", "t2").agg(F.sum("n").alias("repeated")).join(in_all, ["t1", "t2"])
                     .where(F.col("repeated") >= COPY_SHARE * F.col("words")).select("t1", "t2"), "copies")
    if verified:
        copies = written(_near_copies(texts, found.select("t1", "t2", "place"), copies), "verified-copies")
    drop = per_text.join(copies, ["t1", "t2"], "left_anti")
    if keep_first:
        drop = drop.join(first, "template").where(~((F.col("t1") == F.col("first.t1")) & (F.col("t2") == F.col("first.t2"))
                                                    & (F.col("place") == F.col("first.place"))))
    return drop.groupBy("t1", "t2").agg(F.collect_set("place").alias("places"))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with recurring lines taken out of the text, and the numbers
    ``n_lines`` before and ``n_dropped``."""
    places = written(recurring_lines(docs, id_col, text_col, **options), "dropped-lines")
    text = F.col(f"`{text_col}`")
    keyed = docs.withColumns({"line dedup 1": F.xxhash64(text), "line dedup 2": F.xxhash64(F.lit(7), text)})
    names = places.select(F.col("t1").alias("line dedup 1"), F.col("t2").alias("line dedup 2"),
                          F.col("places").alias("line dedup places"))
    # rows whose text loses nothing are not shuffled
    touched, whole = split_by(keyed, "line dedup 1", names)
    joined = touched.join(names, ["line dedup 1", "line dedup 2"], "left").unionByName(
        whole.withColumn("line dedup places", F.lit(None).cast(names.schema["line dedup places"].dataType)))
    dropped = F.col("line dedup places")
    rest = F.array_join(F.filter(F.split(text, "\n"), lambda line, at: ~F.array_contains(dropped, at)), "\n")
    return joined.select(
        *[F.when(dropped.isNull(), text).otherwise(rest).alias(c) if c == text_col else F.col(f"`{c}`")
          for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(dropped), F.lit(0)).cast("long").alias("n_dropped"))


def line_digests(docs: DataFrame) -> DataFrame:
    """Per document the counts and the digest of the text that remains."""
    done = drop_recurring_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


ORACLE = f"""
WITH texts AS (SELECT text, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY text),
cut AS (SELECT id, text, unnest(string_split(text, chr(10))) AS content,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM texts),
worded AS (SELECT id, place, list_transform(
                  list_filter(string_split_regex(content, '[ \\t\\r\\f\\x0B]+'), lambda w: w <> ''),
                  lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '{FIELD}' ELSE w END) AS words FROM cut),
counted AS (SELECT id, place, words, len(words) AS n FROM worded),
lines AS (SELECT *, [CAST(n AS VARCHAR)] || words[1:{DEPTH}] AS leaf FROM counted WHERE n >= {MIN_TOKENS}),
kinds AS (SELECT leaf, words, count(DISTINCT id) AS texts FROM lines GROUP BY leaf, words),
spread AS (SELECT leaf, words, texts, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM kinds),
constants AS (SELECT leaf, pos, word FROM spread WHERE word <> '{FIELD}' GROUP BY leaf, pos, word
              HAVING sum(texts) >= {MIN_DOCS}),
shaped AS (SELECT s.leaf, s.words, count(*) AS n, count(c.word) AS n_fixed,
                  list(CASE WHEN c.word IS NULL THEN '{FIELD}' ELSE s.word END ORDER BY s.pos) AS template
           FROM spread s LEFT JOIN constants c ON s.leaf = c.leaf AND s.pos = c.pos AND s.word = c.word
           WHERE s.texts < {MIN_DOCS} GROUP BY s.leaf, s.words),
templates AS (SELECT leaf, words, 'general' AS kind, template FROM shaped WHERE n_fixed >= {CONSTANT} * n
              UNION ALL SELECT leaf, words, 'exact', words FROM kinds WHERE texts >= {MIN_DOCS}),
held AS (SELECT t.kind, t.leaf, t.template FROM templates t JOIN lines l ON t.leaf = l.leaf AND t.words = l.words
         GROUP BY t.kind, t.leaf, t.template HAVING count(DISTINCT l.id) >= {MIN_DOCS}),
found AS (SELECT l.id, l.place, l.n, t.kind, t.leaf, t.template FROM lines l
          JOIN templates t ON t.leaf = l.leaf AND t.words = l.words
          JOIN held h ON h.kind = t.kind AND h.leaf = t.leaf AND h.template = t.template),
firsts AS (SELECT kind, leaf, template, min([id, place]) AS first FROM found GROUP BY kind, leaf, template),
shares AS (SELECT id, sum(n) AS total FROM counted GROUP BY id),
repeated AS (SELECT id, sum(n) AS again FROM found GROUP BY id),
copies AS (SELECT id FROM repeated JOIN shares USING (id) WHERE again >= {COPY_SHARE} * total),
gone AS (SELECT f.id, f.place FROM found f JOIN firsts s USING (kind, leaf, template)
         WHERE f.id NOT IN (SELECT id FROM copies) AND [f.id, f.place] <> s.first),
kept AS (SELECT c.text, count(*) AS n_lines, count(g.place) AS n_dropped,
                coalesce(string_agg(c.content, chr(10) ORDER BY c.place) FILTER (WHERE g.place IS NULL), '') AS rest
         FROM cut c LEFT JOIN gone g ON c.id = g.id AND c.place = g.place GROUP BY c.text)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_dropped, 0) AS BIGINT) AS n_dropped,
       sha256(k.rest) AS text_sha256
FROM documents d LEFT JOIN kept k ON d.text = k.text
"""
