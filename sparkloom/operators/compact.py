"""Sets of whole numbers in containers whose form follows their density.

A bucket holds 32768 numbers.  Its container is a sorted array of places (two
bytes each), runs of places (four bytes each: first place and how many follow)
or 512 words of 64 bits, whichever takes the fewest bytes.  Operations work on
containers of any two forms as column expressions: places against places with
array functions, words against words bit by bit, places against words by
looking each place up; nothing is exploded into rows but by ``members``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET, WORDS = 1 << 15, 512
FORM = "struct<kind:string,n:int,items:array<smallint>,words:array<bigint>>"
_NO_ITEMS, _NO_WORDS = "cast(array() as array<smallint>)", "cast(array() as array<bigint>)"

# Expressions over {x}: places (sorted array<int>), words (array<bigint>) or a container.
#: Places of the bits that are set.
PLACES_OF_WORDS = "flatten(transform({x}, (w, i) -> if(w = 0, cast(array() as array<int>), filter(transform(sequence(0, 63), b -> if(getbit(w, b) = 1, i * 64 + b, -1)), p -> p >= 0))))"
#: Words of sorted places: each is closed when the next one begins.
WORDS_OF_PLACES = """
if(size({x}) = 0, array_repeat(0L, 512), aggregate({x}, named_struct('at', 0, 'bits', 0L, 'out', cast(array() as array<bigint>)),
  (a, p) -> if(p div 64 = a.at, named_struct('at', a.at, 'bits', a.bits | shiftleft(1L, p % 64), 'out', a.out),
    named_struct('at', cast(p div 64 as int), 'bits', shiftleft(1L, p % 64), 'out', concat(a.out, array(a.bits), array_repeat(0L, cast(p div 64 as int) - a.at - 1)))),
  a -> concat(a.out, array(a.bits), array_repeat(0L, 511 - a.at))))"""
RUNS_OF_PLACES = "size(filter({x}, (p, i) -> i = 0 or {x}[i - 1] <> p - 1))"
RUNS_OF_WORDS = "aggregate(transform({x}, (w, i) -> bit_count(w & ~(shiftleft(w, 1) | if(i > 0, shiftrightunsigned({x}[i - 1], 63), 0L)))), 0, (a, n) -> a + n)"
#: First place of each run and how many follow, one after the other.
ITEMS_OF_RUNS = """
flatten(zip_with(filter({x}, (p, i) -> i = 0 or {x}[i - 1] <> p - 1), filter({x}, (p, i) -> i = size({x}) - 1 or {x}[i + 1] <> p + 1),
  (s, e) -> array(cast(s as smallint), cast(e - s as smallint))))"""
PLACES_OF_RUNS = "flatten(transform(sequence(0, size({x}.items) div 2 - 1), i -> sequence(cast({x}.items[2 * i] as int), {x}.items[2 * i] + {x}.items[2 * i + 1])))"


def _as(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` computed once under a name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _of_places(places: str) -> str:
    """Container of sorted places."""
    runs, n = RUNS_OF_PLACES.format(x="ps"), "size(ps)"
    words = WORDS_OF_PLACES.format(x="ps")
    body = f"""
case when 4 * {runs} < 2 * {n} and 4 * {runs} < 4096 then named_struct('kind', 'runs', 'n', {n}, 'items', {ITEMS_OF_RUNS.format(x="ps")}, 'words', {_NO_WORDS})
     when 2 * {n} < 4096 then named_struct('kind', 'array', 'n', {n}, 'items', transform(ps, p -> cast(p as smallint)), 'words', {_NO_WORDS})
     else named_struct('kind', 'words', 'n', {n}, 'items', {_NO_ITEMS}, 'words', {words}) end"""
    return _as("ps", places, body)


def _of_words(words: str) -> str:
    """Container of 512 words, which become places only if they are few or lie in few runs."""
    n, runs = "aggregate(ws, 0, (a, w) -> a + bit_count(w))", RUNS_OF_WORDS.format(x="ws")
    body = f"""
if({n} * 2 >= 4096 and {runs} * 4 >= 4096, named_struct('kind', 'words', 'n', {n}, 'items', {_NO_ITEMS}, 'words', ws), {_of_places(PLACES_OF_WORDS.format(x="ws"))})"""
    return _as("ws", words, body)


def _places(c: str) -> str:
    return f"case {c}.kind when 'array' then transform({c}.items, p -> cast(p as int)) when 'runs' then {PLACES_OF_RUNS.format(x=c)} else {PLACES_OF_WORDS.format(x=f'{c}.words')} end"


def _words(c: str) -> str:
    return f"if({c}.kind = 'words', {c}.words, {_as('wp', _places(c), WORDS_OF_PLACES.format(x='wp'))})"


def _has_word(c: str, p: str) -> str:
    return f"getbit({c}.words[cast({p} div 64 as int)], cast({p} % 64 as int)) = 1"


def contains_place(container: str, place: str) -> str:
    """SQL condition: whether a container holds a place, by its form."""
    return f"""
case {container}.kind when 'words' then {_has_word(container, place)} when 'array' then array_contains({container}.items, cast({place} as smallint))
  else exists(sequence(0, size({container}.items) div 2 - 1), i -> {place} between {container}.items[2 * i] and {container}.items[2 * i] + {container}.items[2 * i + 1]) end"""


def _and(a: str, b: str) -> str:
    return f"""
case when {a}.kind = 'words' and {b}.kind = 'words' then {_of_words(f"zip_with({a}.words, {b}.words, (x, y) -> x & y)")}
     when {a}.kind = 'words' then {_of_places(f"filter({_places(b)}, q -> {_has_word(a, 'q')})")}
     when {b}.kind = 'words' then {_of_places(f"filter({_places(a)}, q -> {_has_word(b, 'q')})")}
     else {_of_places(f"array_sort(array_intersect({_places(a)}, {_places(b)}))")} end"""


def _and_not(a: str, b: str) -> str:
    return f"""
case when {a}.kind = 'words' then {_of_words(f"zip_with({a}.words, {_words(b)}, (x, y) -> x & ~y)")}
     when {b}.kind = 'words' then {_of_places(f"filter({_places(a)}, q -> not ({_has_word(b, 'q')}))")}
     else {_of_places(f"array_except({_places(a)}, {_places(b)})")} end"""


def _or(a: str, b: str) -> str:
    return f"""
case when {a}.kind = 'words' or {b}.kind = 'words' then {_of_words(f"zip_with({_words(a)}, {_words(b)}, (x, y) -> x | y)")}
     else {_of_places(f"array_sort(array_union({_places(a)}, {_places(b)}))")} end"""


def compact(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by..., bucket, container) of the distinct non-null values.

    Values meet as words of 64 bits first, on the side that reads them, so
    repeats aren't shuffled and a group gathers 512 words at most.
    """
    v = F.col(value).cast("long")
    placed = df.where(v.isNotNull()).select(*by, F.floor(v / BUCKET).cast("long").alias("bucket"), F.pmod(v, F.lit(BUCKET)).cast("int").alias("_p"))
    placed = placed.select(*by, "bucket", F.expr("cast(_p div 64 as int)").alias("_w"), F.expr("shiftleft(1L, _p % 64)").alias("_bit"))
    words = placed.groupBy(*by, "bucket", "_w").agg(F.bit_or("_bit").alias("_bits")).groupBy(*by, "bucket").agg(F.array_sort(F.collect_list(F.struct("_w", "_bits"))).alias("_ws"))
    places = "flatten(transform(_ws, w -> transform(filter(sequence(0, 63), b -> getbit(w._bits, b) = 1), b -> w._w * 64 + b)))"
    return words.select(*by, "bucket", F.expr(_of_places(places)).alias("container"))


def _both(a: DataFrame, b: DataFrame, by: tuple[str, ...], how: str) -> DataFrame:
    return a.withColumnRenamed("container", "l").join(b.withColumnRenamed("container", "r"), [*by, "bucket"], how)


def union(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """Containers of what either side has, group by group."""
    return _both(a, b, by, "full").select(*by, "bucket", F.expr(f"case when l is null then r when r is null then l else {_or('l', 'r')} end").alias("container"))


def intersection(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """Containers of what both sides have; empty ones go."""
    return _both(a, b, by, "inner").select(*by, "bucket", F.expr(_and("l", "r")).alias("container")).where("container.n > 0")


def difference(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """Containers of what ``a`` has and ``b`` lacks; empty ones go."""
    return _both(a, b, by, "left").select(*by, "bucket", F.expr(f"if(r is null, l, {_and_not('l', 'r')})").alias("container")).where("container.n > 0")


def members(sets: DataFrame, name: str = "value") -> DataFrame:
    """Every number of every container as a row; columns beside bucket and container stay."""
    by = [c for c in sets.columns if c not in ("bucket", "container")]
    return sets.select(*by, "bucket", F.explode(F.expr(_places("container"))).alias("_p")).select(*by, (F.col("bucket") * BUCKET + F.col("_p")).alias(name))


def contained(values: DataFrame, value: str, sets: DataFrame) -> DataFrame:
    """The rows of ``values`` whose number is in the sets; rows stay as they are, repeats too.  Containers are as many as buckets in use."""
    v = F.col(value).cast("long")
    own = values.withColumns({"_bucket": F.floor(v / BUCKET).cast("long"), "_p": F.pmod(v, F.lit(BUCKET)).cast("int")})
    found = own.join(sets.select(F.col("bucket").alias("_bucket"), F.col("container").alias("_c")), "_bucket")
    return found.where(F.expr(contains_place("_c", "_p"))).select(*values.columns)


def bytes_of(container: Column) -> Column:
    """Bytes that a container's numbers take."""
    return 2 * F.size(container["items"]) + 8 * F.size(container["words"])


def sizes(sets: DataFrame, *by: str) -> DataFrame:
    """(by..., kind, containers, numbers, bytes) by form."""
    c = F.col("container")
    return sets.groupBy(*by, c["kind"].alias("kind")).agg(F.count("*").alias("containers"), F.sum(c["n"].cast("long")).alias("numbers"), F.sum(bytes_of(c).cast("long")).alias("bytes"))
