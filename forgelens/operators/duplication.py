"""Line duplication between files: shared distinct lines over the smaller file.

:func:`pair_matrix` compares a short explicit list of files per repository, every pair
of it.  :class:`Duplication` finds, among all files of a repository, every pair above a
similarity, without comparing all pairs:

* files with the same set of lines are one *set* from the start, so a group of copies is
  one row however large it is;
* only lines that several sets have can be common to two of them, so sets of one size
  with the same shared lines are one *family*: files with one header and lines of their
  own beside it are compared once, not with each other;
* two families can only reach the similarity if they share one of the rarest shared
  lines of the smaller one (the prefix rule of set-similarity joins), at places that
  leave enough lines behind them in both.  The index holds (line, place, size); line
  sets themselves move only to the pairs that are left.

Nothing is sampled or capped: the rules leave out only pairs below the similarity.
Results are classes of files with their numbers of links, not pairs; pairs of sets can
be listed where they are wanted.
"""

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.materialize import materialize
from .components import components

KEY = ["repo", "set_id"]
#: A line in more sets than this is dealt out over as many tasks as it has times so many.
DEAL = 4096
#: A line in more sets than this is common: pairs that share no rarer line are counted by classes of sets.
COMMON = 512
#: So many families of a class are met by another one in one task.
MEMBERS = 512
_LINKED = ["repo", *(f"{c}_{letter}" for c in ("family", "n_lines", "n_files", "file") for letter in "ab")]


def _line_hashes(content: Column) -> Column:
    """MD5 of the distinct stripped non-empty lines as hex, sorted."""
    stripped = F.transform(T.raw_lines(content), T.strip)
    distinct = F.array_distinct(F.filter(stripped, lambda line: line != ""))
    return F.sort_array(F.transform(distinct, F.md5))


def similarity(common: Column, smaller: Column) -> Column:
    return F.bround(common / smaller * 100, 1)


def _with_lines(files: DataFrame) -> DataFrame:
    # the test for emptiness is on the text: on the hashes Spark would work
    # them out once for the filter and once more for the result
    kept = files.where(T.strip(F.col("content")) != "")
    hashed = kept.select("repo", "path", _line_hashes(F.col("content")).alias("hashes"))
    return hashed.select(
        "repo",
        "path",
        F.unhex(F.sha2(F.array_join("hashes", ""), 256)).alias("set_id"),
        F.size("hashes").alias("n_lines"),
        "hashes",
    )


def _needed(n_lines: str, min_similarity: int) -> Column:
    """Fewest common lines of a similarity above the bound, for a smaller side of so many.

    A similarity that is rounded to more than a whole number is more than it unrounded.
    """
    return F.expr(f"cast({n_lines} as bigint) * {int(min_similarity)} div 100 + 1").cast("int")


class Duplication:
    """Duplication within the repositories of ``files(repo, path, content)``.

    Similarities are in percent, to one decimal; a link is a pair of files above
    ``min_similarity``.  Files without a line, or without text, take no part.  Content is
    read once; what several results need is written to the shared folder when this is
    made.
    """

    def __init__(self, files: DataFrame, min_similarity: int = 60):
        self.min_similarity = min_similarity
        lines = materialize(_with_lines(files), "file-lines")
        self.files = lines.drop("hashes")
        tokens = lines.select(*KEY, "path", "n_lines", F.explode("hashes").alias("line"))
        # one row per set and line, copies combined on the map side
        tokens = tokens.groupBy(*KEY, "n_lines", F.unhex("line").alias("line")).agg(
            F.min("path").alias("file"), F.count("*").alias("copies")
        )
        tokens = materialize(tokens, "set-lines")
        frequency = tokens.groupBy("repo", "line").agg(F.count("*").alias("frequency")).where("frequency > 1")
        # written, so that the numbers stay, and so that a line of many sets can be split in the join
        numbered = materialize(frequency.withColumn("number", F.monotonically_increasing_id()), "shared-lines")
        entry = F.when(F.col("number").isNotNull(), F.struct("frequency", "number"))
        sets = tokens.join(numbered, ["repo", "line"], "left").groupBy(*KEY, "n_lines", "file", "copies")
        sets = sets.agg(F.sort_array(F.collect_list(entry)).alias("shared"))
        # a set that shares no line is a family of its own
        numbers = F.array_join(F.col("shared.number").cast("array<string>"), ",")
        alike = F.when(F.size("shared") == 0, F.col("set_id")).otherwise(F.unhex(F.sha2(numbers, 256)))
        self._line_sets = materialize(sets.withColumn("alike", alike), "line-sets")
        families = self._line_sets.groupBy("repo", "n_lines", "alike").agg(
            F.min("file").alias("file"),
            F.count("*").alias("n_sets"),
            F.sum("copies").alias("n_files"),
            F.sum(F.col("copies") * F.col("copies")).alias("squares"),
            F.first("shared").alias("shared"),
        )
        families = families.withColumns({"size": F.size("shared"), "family": F.monotonically_increasing_id()})
        self.families = materialize(families, "families")

    @cached_property
    def links(self) -> DataFrame:
        """Linked pairs of families, see :meth:`_linked`."""
        return materialize(self._linked(), "family-links")

    @cached_property
    def sets(self) -> DataFrame:
        """(repo, set_id, n_lines, file, copies, family) of every line set."""
        names = self.families.select("repo", "n_lines", "alike", "family")
        own = self._line_sets.drop("shared").join(names, ["repo", "n_lines", "alike"])
        return materialize(own.drop("alike"), "sets")

    def _candidates(self, families: DataFrame | None = None, most: int | None = None) -> DataFrame:
        """Pairs (a, b), a the smaller, that share a line of a's prefix with enough lines behind it.

        With ``most`` the line is in no more sets than that.
        """
        needed = _needed("n_lines", self.min_similarity)
        index = (self.families if families is None else families).select(
            "repo", "family", "n_lines", "size", F.posexplode("shared").alias("place", "entry")
        ).select("repo", "family", "n_lines", "size", "place", "entry.number", "entry.frequency")
        if most is not None:
            index = index.where(F.col("frequency") <= most)
        deal = F.expr(f"cast(frequency div {DEAL} as int)")
        left = index.where(F.col("place") <= F.col("size") - needed).select(
            "repo", "number", F.explode(F.sequence(F.lit(0), deal)).alias("deal"),
            *[F.col(c).alias(f"{c}_a") for c in ("family", "n_lines", "size", "place")],
        )
        right = index.select(
            "repo", "number", F.pmod(F.xxhash64("family"), deal + 1).cast("int").alias("deal"),
            *[F.col(c).alias(f"{c}_b") for c in ("family", "n_lines", "size", "place")],
        )
        smaller = F.struct("n_lines_a", "family_a") < F.struct("n_lines_b", "family_b")
        behind = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
        return (
            left.join(right, ["repo", "number", "deal"])
            .where(smaller & (behind >= _needed("n_lines_a", self.min_similarity)))
            .select("family_a", "family_b")
            .distinct()
        )

    def _linked(self) -> DataFrame:
        """(repo, family_a, family_b, common_lines, similarity_percent, n_pairs, file_a, file_b).

        Pairs that share a line of no more than ``COMMON`` sets are compared line by line.  All
        others have only the lines of their classes in common, so that these are compared
        once for all of their families.
        """
        return self._rarer_links.unionByName(self._class_links()).select(
            "repo", "family_a", "family_b", F.col("n").cast("bigint").alias("common_lines"), "similarity_percent",
            (F.col("n_files_a") * F.col("n_files_b")).alias("n_pairs"),
            F.least("file_a", "file_b").alias("file_a"), F.greatest("file_a", "file_b").alias("file_b"),
        )

    @cached_property
    def _rarer_links(self) -> DataFrame:
        """Linked pairs of families that share a line of no more than ``COMMON`` sets, a the smaller."""

        def side(letter: str) -> DataFrame:
            numbers = F.col("shared.number").alias(f"numbers_{letter}")
            columns = [F.col(c).alias(f"{c}_{letter}") for c in ("family", "n_lines", "n_files", "file")]
            return self.families.select(*(["repo"] if letter == "a" else []), *columns, numbers)

        # one array expression, so that an intersection is worked out once per pair
        common = F.array(F.size(F.array_intersect("numbers_a", "numbers_b")))
        above = F.filter(common, lambda n: self._above(n, F.col("n_lines_a")))
        rarer = self._candidates(most=COMMON).join(side("a"), "family_a").join(side("b"), "family_b")
        rarer = rarer.select(*_LINKED, F.explode(above).alias("n"))
        rarer = rarer.withColumn("similarity_percent", similarity(F.col("n"), F.col("n_lines_a")))
        return materialize(rarer, "rarer-links")

    def _class_links(self, members: DataFrame | None = None) -> DataFrame:
        """Pairs of families that are linked by the lines of their classes alone, a the smaller.

        With ``members(class, family, plain, file, n_lines, n_files)`` pairs of these, their sets:
        those of one family too where it is plain, without a line of fewer sets.

        A member meets those of the classes in whose lines it is similar enough, if it is the
        smaller one; what it meets in vain is linked with it the other way round.  The
        members of a class are dealt out by ``MEMBERS``.  What is moved are members, once for
        each class and deal that they meet: pairs come out of the last join and nothing follows
        it, so a member knows before which families it is linked with by rarer lines.
        """
        pairs, members = self._class_pairs(), self._class_families if members is None else members
        n_tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        deals = members.groupBy("class").agg(F.expr(f"cast(count(*) div {MEMBERS} as int)").alias("deals"))
        deals = materialize(deals, "class-deals")
        # a family that is not plain has few sets and stays in one deal
        dealt = F.pmod(F.xxhash64("family", F.when(F.col("plain"), F.col("file"))), F.col("deals") + 1)
        members = members.join(deals, "class").select("*", dealt.cast("int").alias("deal")).drop("deals")
        members = materialize(members, "dealt-members")

        def side(letter: str) -> DataFrame:
            columns = ["class", "deal", "family", "n_lines", "n_files", "file", *(["plain"] if letter == "a" else [])]
            return members.select([F.col(c).alias(f"{c}_{letter}") for c in columns])

        turned = pairs.where("family_a <> family_b").select("repo", F.col("family_b"), F.col("family_a"), "n")
        pairs = pairs.select("repo", "family_a", "family_b", "n").union(turned)
        pairs = pairs.withColumnsRenamed({"family_a": "class_a", "family_b": "class_b"})
        linked = self._rarer_links.select("family_a", "family_b")
        for letter in "ab":
            numbered = deals.select(F.col("class").alias(f"class_{letter}"), F.sequence(F.lit(0), "deals").alias("deals"))
            pairs = pairs.join(numbered, f"class_{letter}").withColumn(f"deal_{letter}", F.explode("deals")).drop("deals")
            rarer = members.where(~F.col("plain")).select("class", "deal", "family").distinct()
            linked = linked.join(rarer.select([F.col(c).alias(f"{c}_{letter}") for c in rarer.columns]), f"family_{letter}")
        places = ["class_a", "deal_a", "class_b", "deal_b"]
        linked = linked.groupBy(*places).agg(F.collect_list(F.struct("family_a", "family_b")).alias("linked"))
        own = F.filter("linked", lambda pair: pair["family_a"] == F.col("family_a"))["family_b"]
        # few rows make many: without a number they would be put together by their size
        smaller = pairs.join(linked, places, "left").repartition(n_tasks, "class_a", "deal_a")
        smaller = smaller.join(side("a"), ["class_a", "deal_a"]).drop("class_a", "deal_a").withColumns(
            {"similarity_percent": similarity(F.col("n"), F.col("n_lines_a")), "linked": own}
        )
        smaller = smaller.where(F.col("similarity_percent") > self.min_similarity)
        met = smaller.repartition(n_tasks, "class_b", "deal_b").join(side("b"), ["class_b", "deal_b"])
        lines_a, lines_b, family_a, family_b = (F.col(c) for c in ("n_lines_a", "n_lines_b", "family_a", "family_b"))
        within = (family_a == family_b) & F.col("plain_a") & (F.col("file_a") < F.col("file_b"))
        first = (lines_a < lines_b) | ((lines_a == lines_b) & ((family_a < family_b) | within))
        known = F.coalesce(F.array_contains("linked", family_b), F.lit(False))
        return met.where(first & ~known).select(*_LINKED, "n", "similarity_percent")

    def _above(self, common: Column, smaller: Column) -> Column:
        return similarity(common, smaller) > self.min_similarity

    @cached_property
    def _line_classes(self) -> DataFrame:
        """Families with the same common lines, those of more than ``COMMON`` sets, as classes."""
        sized = self.families.select("repo", self._common().alias("shared"), "n_lines", "n_files").groupBy(
            "repo", "shared", "n_lines"
        ).agg(F.sum("n_files").alias("files"), F.sum(F.col("n_files") * F.col("n_files")).alias("squares"))
        classes = sized.where(F.size("shared") > 0).groupBy("repo", "shared").agg(
            F.sort_array(F.collect_list(F.struct("n_lines", "files", "squares"))).alias("sizes"),
            F.min("n_lines").alias("n_lines"),
        )
        return materialize(
            classes.withColumns({"size": F.size("shared"), "family": F.monotonically_increasing_id()}), "line-classes"
        )

    def _common(self) -> Column:
        return F.filter("shared", lambda e: e["frequency"] > COMMON)

    def _by_class(self) -> DataFrame:
        """Pairs of files as if they had no lines in common but those of more than ``COMMON`` sets.

        (repo, similarity_percent, n_pairs) of files of different families.  Families with the
        same common lines are a class, whatever their other lines; a class holds its numbers
        of files by numbers of lines, and the smaller of two files says how similar they are.
        """
        classes = self._line_classes

        def side(letter: str) -> DataFrame:
            columns = [F.col(c).alias(f"{c}_{letter}") for c in ("family", "n_lines", "sizes")]
            return classes.select("repo", *columns, F.col("shared.number").alias(f"numbers_{letter}"))

        def longer(sizes: str, than: Column, or_equal: bool) -> Column:
            kept = F.filter(sizes, lambda o: (o["n_lines"] >= than) if or_equal else (o["n_lines"] > than))
            return F.aggregate(kept, F.lit(0).cast("bigint"), lambda total, o: total + o["files"])

        def rows(sizes: str, n: Column, n_pairs) -> Column:
            return F.transform(
                F.filter(sizes, lambda e: self._above(n, e["n_lines"])),
                lambda e: F.struct(
                    similarity(n, e["n_lines"]).alias("similarity_percent"), n_pairs(e).cast("bigint").alias("n_pairs")
                ),
            )

        paired = self._candidates(classes).join(side("a"), "family_a").join(side("b").drop("repo"), "family_b").select(
            "repo", "n_lines_a", "sizes_a", "sizes_b", F.size(F.array_intersect("numbers_a", "numbers_b")).alias("n")
        )
        n = F.col("n")
        across = paired.where(self._above(n, F.col("n_lines_a"))).select("repo", F.inline(F.concat(
            rows("sizes_a", n, lambda e: e["files"] * longer("sizes_b", e["n_lines"], True)),
            rows("sizes_b", n, lambda e: e["files"] * longer("sizes_a", e["n_lines"], False)),
        )))
        within = classes.select("repo", F.inline(rows("sizes", F.col("size"), lambda e: (
            e["files"] * longer("sizes", e["n_lines"], False) + F.floor((e["files"] * e["files"] - e["squares"]) / 2)
        ))))
        return across.unionByName(within)

    def _class_pairs(self) -> DataFrame:
        """(repo, family_a, family_b, n_lines_a, n) of classes, and of each with itself, that may hold links."""
        classes = self._line_classes

        def side(letter: str) -> DataFrame:
            columns = [F.col(c).alias(f"{c}_{letter}") for c in ("family", "n_lines")]
            return classes.select("repo", *columns, F.col("shared.number").alias(f"numbers_{letter}"))

        n = F.size(F.array_intersect("numbers_a", "numbers_b"))
        paired = self._candidates(classes).join(side("a"), "family_a").join(side("b").drop("repo"), "family_b").select(
            "repo", "family_a", "family_b", "n_lines_a", n.alias("n")
        )
        family = F.col("family")
        alone = classes.select("repo", family.alias("family_a"), family.alias("family_b"), F.col("n_lines").alias("n_lines_a"), F.col("size").alias("n"))
        return paired.unionByName(alone).where(self._above(F.col("n"), F.col("n_lines_a")))

    @cached_property
    def _class_families(self) -> DataFrame:
        """(class, family, file, n_lines, n_files, plain) of every family with common lines; a plain one has no others."""
        named = self._line_classes.select("repo", "shared", F.col("family").alias("class"))
        plain = F.size(self._common()) == F.size("shared")
        members = self.families.select(
            "repo", self._common().alias("shared"), "family", "file", "n_lines", "n_files", plain.alias("plain")
        )
        return materialize(members.join(named, ["repo", "shared"]).drop("repo", "shared"), "class-families")

    def _by_class_and_file(self) -> DataFrame:
        """The pairs of :meth:`_by_class` as (repo, file, similarity_percent, n_pairs).

        A row is of a family and a class of others: its pairs with families whose first file
        comes later, and the highest similarity of these.  The families of two classes are
        gone through from the last first file on; running sums hold what came before, so the
        rows are as many as two classes have families and not as their pairs.  They are
        sorted for each pair of classes in one task.
        """
        pairs, members = self._class_pairs(), self._class_families.drop("family")
        ends = F.array_distinct(F.array("family_a", "family_b"))
        met = pairs.select("repo", "family_a", "family_b", "n", F.explode(ends).alias("class")).join(members, "class")
        in_a, same = F.col("class") == F.col("family_a"), F.col("family_a") == F.col("family_b")
        before = Window.partitionBy("family_a", "family_b").orderBy(F.desc("file"))
        before = before.rowsBetween(Window.unboundedPreceding, -1)

        def others(aggregate, value: Column) -> Column:
            of_a, of_b = (aggregate(F.when(own, value)).over(before) for own in (in_a, ~in_a))
            return F.when(same | ~in_a, of_a).otherwise(of_b)

        n, above = F.col("n"), self._above(F.col("n"), F.col("n_lines"))
        counted = met.select(
            "repo", "file", "n", "n_lines", above.alias("above"),
            others(F.sum, F.col("n_files")).alias("every"),
            others(F.sum, F.when(above, F.col("n_files"))).alias("small"),
            others(F.min, F.col("n_lines")).alias("least"), "n_files",
        )
        n_others = F.when(F.col("above"), F.col("every")).otherwise(F.col("small"))
        return counted.where(n_others > 0).select(
            "repo", "file", similarity(n, F.least("n_lines", "least")).alias("similarity_percent"),
            (F.col("n_files") * n_others).alias("n_pairs"),
        )

    def _by_rarer(self) -> DataFrame:
        """What :meth:`_by_class` has wrong: pairs that share a rarer line, with and without it."""

        def side(letter: str) -> DataFrame:
            common = self._common()
            columns = [F.col(c).alias(f"{c}_{letter}") for c in ("family", "n_lines", "n_files", "file")]
            return self.families.select(
                *(["repo"] if letter == "a" else []), *columns,
                F.col("shared.number").alias(f"numbers_{letter}"), common["number"].alias(f"common_{letter}"),
            )

        pairs = self._candidates(most=COMMON).join(side("a"), "family_a").join(side("b"), "family_b").select(
            "repo", F.least("file_a", "file_b").alias("file"), "n_lines_a",
            (F.col("n_files_a") * F.col("n_files_b")).alias("n_pairs"),
            F.array(
                F.struct(F.size(F.array_intersect("numbers_a", "numbers_b")).alias("n"), F.lit(1).alias("sign")),
                F.struct(F.size(F.array_intersect("common_a", "common_b")).alias("n"), F.lit(-1).alias("sign")),
            ).alias("counts"),
        )
        counted = pairs.select("repo", "file", "n_lines_a", "n_pairs", F.inline("counts"))
        return counted.where(self._above(F.col("n"), F.col("n_lines_a"))).select(
            "repo", "file", similarity(F.col("n"), F.col("n_lines_a")).alias("similarity_percent"),
            (F.col("n_pairs") * F.col("sign")).alias("n_pairs"),
        )

    def by_similarity(self) -> DataFrame:
        """Numbers of links as (repo, similarity_percent, n_pairs): those of :meth:`by_family`, summed.

        Pairs of families are only listed where they share a line of no more than ``COMMON``
        sets; the others are counted by classes of families.
        """
        columns = ["repo", "similarity_percent", "n_pairs"]
        frames = [f.select(*columns) for f in (self._by_class(), self._by_rarer(), *self._inside())]
        every = frames[0]
        for frame in frames[1:]:
            every = every.unionByName(frame)
        found = every.groupBy("repo", "similarity_percent").agg(F.sum("n_pairs").alias("n_pairs"))
        return found.where("n_pairs > 0")

    def by_file(self) -> DataFrame:
        """The rows of :meth:`by_family` as one per file: (repo, file, similarity_percent, n_pairs).

        The similarity is the highest one, the number of pairs their sum.  Pairs of families
        are only listed where they share a line of no more than ``COMMON`` sets.  A listed
        pair counts once with its own similarity and is taken off once as its classes have it,
        which is no higher, so that the highest of what is added is right.
        """
        every = self._by_class_and_file().unionByName(self._by_rarer())
        for frame in self._inside():
            every = every.unionByName(frame)
        added = F.when(F.col("n_pairs") > 0, F.col("similarity_percent"))
        found = every.groupBy("repo", "file").agg(F.max(added).alias("similarity_percent"), F.sum("n_pairs").alias("n_pairs"))
        return found.where("n_pairs > 0")

    def _alike(self) -> Column:
        """Similarity of two different sets of one family."""
        return similarity(F.col("size"), F.col("n_lines"))

    def by_family(self) -> DataFrame:
        """Numbers of links as (repo, file, similarity_percent, n_pairs).

        A row counts the pairs of files of one similarity between two families, between
        the sets of one, or between the copies of its sets, under the first file of these.
        """
        across = self.links.select("repo", F.col("file_a").alias("file"), "similarity_percent", "n_pairs")
        inner, copies = self._inside()
        return across.unionByName(inner).unionByName(copies)

    def _inside(self) -> tuple[DataFrame, DataFrame]:
        """The rows of :meth:`by_family` for pairs of different sets of a family, and of copies of a set."""
        inner = self._inner().select(
            "repo", "file", self._alike().alias("similarity_percent"),
            F.expr("cast((n_files * n_files - squares) / 2 as bigint)").alias("n_pairs"),
        )
        copies = self.families.where("squares > n_files").select(
            "repo", "file", F.lit(100.0).alias("similarity_percent"),
            F.expr("cast((squares - n_files) / 2 as bigint)").alias("n_pairs"),
        )
        return inner, copies

    def _inner(self) -> DataFrame:
        """Families whose different sets are linked with each other."""
        return self.families.where((F.col("n_sets") > 1) & (self._alike() > self.min_similarity))

    def _copied(self) -> DataFrame:
        """Sets of several files, linked with themselves by their first and last file."""
        last = self.files.groupBy(*KEY).agg(F.max("path").alias("file_b"))
        return self.sets.where("copies > 1").join(last, KEY).select(
            "repo", "family", F.col("file").alias("file_a"), "file_b",
            F.col("n_lines").cast("bigint").alias("common_lines"), F.lit(100.0).alias("similarity_percent"),
            F.expr("cast(copies * (copies - 1) / 2 as bigint)").alias("n_pairs"), "copies",
        )

    def counted(self) -> DataFrame:
        """Links as (repo, family, file_a, file_b, common_lines, similarity_percent, n_pairs, copies).

        As :meth:`by_family`, a row per set for copies (with their number), with the first
        pair of set names each row stands for.
        """
        nth = F.row_number().over(Window.partitionBy("family").orderBy("file"))
        second = self.sets.withColumn("nth", nth).where("nth <= 2").where("nth = 2")
        inner = self._inner().join(second.select("family", F.col("file").alias("file_b")), "family").select(
            "repo", "family", F.col("file").alias("file_a"), "file_b",
            F.col("size").cast("bigint").alias("common_lines"), self._alike().alias("similarity_percent"),
            F.expr("cast((n_files * n_files - squares) / 2 as bigint)").alias("n_pairs"),
        )
        across = self.links.withColumnRenamed("family_a", "family").drop("family_b")
        return across.unionByName(inner).unionByName(self._copied(), allowMissingColumns=True)

    @cached_property
    def classes_of(self) -> DataFrame:
        """(family, class_id, n_files) of every family that links connect, named by its class's first path.

        The sets of a family are connected if they are linked with each other, or all of
        them with those of another family.  Otherwise each set is on its own.
        """
        ends = self.links.select(F.col("family_a").alias("a"), F.col("family_b").alias("b"))
        found = components(ends).select(F.col("node").alias("family"), F.col("component").alias("label"))
        inner = self._inner().select(F.col("family").alias("alone"))
        labels = found.join(inner, F.col("family") == F.col("alone"), "full").select(
            F.coalesce("family", "alone").alias("family"), F.coalesce("label", "alone").alias("label")
        )
        labels = materialize(labels.join(self.families.select("family", "file", "n_files"), "family"), "labels")
        # written, so that the families of a large class can be split among the tasks of the join
        named = labels.groupBy("label").agg(F.min("file").alias("class_id"), F.sum("n_files").alias("n_files"))
        return labels.select("family", "label").join(materialize(named, "classes"), "label").drop("label")

    def classes(self) -> DataFrame:
        """One row per class: files that links connect, directly or through others.

        repo, class_id (its first path), n_files, n_links (pairs of files above the
        similarity), and the closest pair with its similarity and common lines: of equal
        similarities the first paths.  Files without a link are in no class.
        """
        links = self.counted().join(self.classes_of, "family", "left").withColumns({
            "class_id": F.coalesce("class_id", "file_a"), "n_files": F.coalesce("n_files", "copies"),
        })
        closest = F.struct(
            (-F.col("similarity_percent")).alias("order"), "file_a", "file_b", "common_lines", "similarity_percent"
        )
        found = links.groupBy("repo", "class_id", "n_files").agg(
            F.sum("n_pairs").alias("n_links"), F.min(closest).alias("closest")
        )
        return found.select("repo", "class_id", "n_files", "n_links", "closest.file_a", "closest.file_b",
                            "closest.common_lines", "closest.similarity_percent")

    def members(self) -> DataFrame:
        """One row per file of a class: repo, class_id, path, n_lines, n_links, closest_percent.

        ``n_links`` is the number of files it is linked to, ``closest_percent`` its
        highest similarity to one of them.
        """
        one = self.links.select("similarity_percent", F.col("family_a").alias("family"), F.col("family_b").alias("other"))
        other = self.links.select("similarity_percent", F.col("family_b").alias("family"), F.col("family_a").alias("other"))
        sizes = self.families.select(F.col("family").alias("other"), "n_files")
        across = one.union(other).join(sizes, "other").groupBy("family").agg(
            F.sum("n_files").alias("across"), F.max("similarity_percent").alias("closest")
        )
        inner = F.when((F.col("n_sets") > 1) & (self._alike() > self.min_similarity), F.col("n_files"))
        families = self.families.select(
            "family", inner.alias("inner"), F.when(inner.isNotNull(), self._alike()).alias("inner_percent")
        )
        numbers = self.sets.join(families.join(across, "family", "left"), "family").select(
            *KEY, "family", "file",
            (F.col("copies") - 1 + F.coalesce(F.col("inner") - F.col("copies"), F.lit(0))
             + F.coalesce("across", F.lit(0))).alias("n_links"),
            F.greatest(F.when(F.col("copies") > 1, 100.0), "inner_percent", "closest").alias("closest_percent"),
        ).where("n_links > 0")
        numbers = materialize(numbers.join(self.classes_of, "family", "left"), "set-numbers")
        return self.files.join(numbers.drop("n_lines"), KEY).select(
            "repo", F.coalesce("class_id", "file").alias("class_id"), "path", F.col("n_lines").cast("bigint").alias("n_lines"), "n_links", "closest_percent"
        )

    def pairs(self) -> DataFrame:
        """Pairs of sets: repo, file_a, file_b, common_lines, similarity_percent, n_pairs.

        A set is named by its first file; a set with copies also stands for itself, with
        its first and last file.  The rows are as many as there are pairs of different
        sets above the similarity: :meth:`classes` says the same in rows that grow with
        the files.
        """
        classes = self._class_families.select("class", "family", "plain")
        own = classes.join(self.sets.select("family", "n_lines", "file", F.col("copies").alias("n_files")), "family")
        # the many: these rows leave the task that makes them for the result only
        across = self._class_links(own).withColumns({"copies_a": F.col("n_files_a"), "copies_b": F.col("n_files_b")})
        # families with a rarer line have few sets
        left = self.sets.select("family", *[F.col(c).alias(f"{c}_a") for c in ("file", "copies")])
        right = left.toDF("family_", "file_b", "copies_b")
        rarer = self._rarer_links.drop("file_a", "file_b").join(left, F.col("family_a") == left["family"]).drop("family")
        rarer = rarer.join(right, F.col("family_b") == right["family_"])
        inner = self._inner().where(F.exists("shared", lambda e: e["frequency"] <= COMMON)).select(
            "repo", F.col("family").alias("within"), F.col("size").alias("n"), self._alike().alias("similarity_percent")
        )
        inner = inner.join(left, F.col("within") == left["family"]).join(
            right, (F.col("within") == right["family_"]) & (F.col("file_a") < F.col("file_b"))
        )
        columns = ["repo", "file_a", "file_b", "copies_a", "copies_b", "n", "similarity_percent"]
        different = across.select(*columns).unionByName(rarer.select(*columns)).unionByName(inner.select(*columns)).select(
            "repo", F.least("file_a", "file_b").alias("file_a"), F.greatest("file_a", "file_b").alias("file_b"),
            F.col("n").cast("bigint").alias("common_lines"), "similarity_percent",
            (F.col("copies_a") * F.col("copies_b")).alias("n_pairs"),
        )
        return different.unionByName(self._copied().drop("family", "copies"))


def similar_pairs(files: DataFrame, min_similarity: int = 60) -> DataFrame:
    """J2/Q6 as pairs of line sets above ``min_similarity`` percent, see :meth:`Duplication.pairs`."""
    return Duplication(files, min_similarity).pairs()


def set_members(files: DataFrame) -> DataFrame:
    """repo, set_file, path, n_lines: every file with the first file of its line set.

    Content is read once; the first files are written, so that the files of a large set
    can be split among the tasks of the join.
    """
    named = materialize(_with_lines(files).drop("hashes"), "file-sets")
    first = materialize(named.groupBy(*KEY).agg(F.min("path").alias("set_file")), "set-files")
    return named.join(first, KEY).select(
        "repo", "set_file", "path", F.col("n_lines").cast("bigint").alias("n_lines")
    )


def pair_matrix(files: DataFrame, chosen: DataFrame) -> DataFrame:
    """J2 for an explicit list: every pair of ``chosen(repo, path, rn)`` in its order.

    Meant for the few files per repository that an analyst selects; pairs
    without a common line and pairs with an empty file are part of the result.
    """
    listed = (
        files.join(chosen, ["repo", "path"])
        .select(
            "repo",
            F.struct("rn", "path", _line_hashes(F.col("content")).alias("digests")).alias("f"),
        )
        .groupBy("repo")
        .agg(F.sort_array(F.collect_list("f")).alias("listed"))
    )
    pairs = F.flatten(
        F.transform(
            "listed",
            lambda a, i: F.transform(
                F.filter("listed", lambda b: b["rn"] > a["rn"]),
                lambda b: F.struct(a.alias("a"), b.alias("b")),
            ),
        )
    )
    common = F.size(F.array_intersect("a.digests", "b.digests"))
    smaller = F.least(F.size("a.digests"), F.size("b.digests"))
    return listed.select("repo", F.inline(pairs)).select(
        "repo",
        F.col("a.path").alias("file_a"),
        F.col("b.path").alias("file_b"),
        F.when(smaller > 0, similarity(common, smaller))
        .otherwise(0.0)
        .alias("similarity_percent"),
        F.when(smaller > 0, common.cast("bigint")).alias("common_lines"),
    )
