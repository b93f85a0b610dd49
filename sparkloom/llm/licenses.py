"""License scans by ordered signature rules, in DataFrame functions only.

A text becomes its lower-case words.  Rules are regular expressions over the
words joined by single spaces; a rule runs only where its keyword, one or more
whole words that it always matches, occurs.
Of overlapping detections, one that lies within another of the same or a
higher priority goes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Priorities: a full license name with its version, a name, a general notice.
EXACT, NAMED, NOTICE = 1, 2, 3


@dataclass(frozen=True)
class Rule:
    label: str
    #: Whole words with single spaces between them; a space is never just optional (not " ?" but "(?: )?").
    pattern: str
    keyword: str
    priority: int
    confidence: float


def _licensed(names: str) -> str:
    return rf"(?:(?:un|re)?licen[sc]ed under |released under |distributed under |under )?(?:the )?(?:terms of )?(?:the )?(?:{names})"


def rules() -> tuple[Rule, ...]:
    """All rules in order: hand-written name patterns of license families, with their versions filled in."""
    out: list[Rule] = []

    def add(label, pattern, keyword, priority, confidence):
        out.append(Rule(label, pattern, keyword, priority, confidence))

    versioned = [
        # label, name pattern, keyword, versions
        ("gpl", r"(?:gnu )?gpl", "gpl", ("1.0", "2.0", "3.0")),
        ("gpl", r"(?:gnu )?general public license", "general public", ("1.0", "2.0", "3.0")),
        ("lgpl", r"(?:gnu )?(?:lesser|library) general public license", "general public", ("2.0", "2.1", "3.0")),
        ("lgpl", r"(?:gnu )?lgpl", "lgpl", ("2.0", "2.1", "3.0")),
        ("agpl", r"(?:gnu )?affero general public license", "affero", ("1.0", "3.0")),
        ("agpl", r"(?:gnu )?agpl", "agpl", ("1.0", "3.0")),
        ("gfdl", r"(?:gnu )?free documentation license", "free documentation", ("1.1", "1.2", "1.3")),
        ("gfdl", r"(?:gnu )?gfdl", "gfdl", ("1.1", "1.2", "1.3")),
        ("apache", r"apache (?:software )?license", "apache", ("1.0", "1.1", "2.0")),
        ("apache", r"apache", "apache", ("1.0", "1.1", "2.0")),
        ("mpl", r"mozilla public license", "mozilla", ("1.0", "1.1", "2.0")),
        ("mpl", r"mpl", "mpl", ("1.0", "1.1", "2.0")),
        ("epl", r"eclipse public license", "eclipse", ("1.0", "2.0")),
        ("epl", r"epl", "epl", ("1.0", "2.0")),
        ("cddl", r"common development and distribution license", "common development", ("1.0", "1.1")),
        ("cddl", r"cddl", "cddl", ("1.0", "1.1")),
        ("cpl", r"common public license", "common public", ("1.0",)),
        ("eupl", r"european union public licen[sc]e", "european union", ("1.0", "1.1", "1.2")),
        ("eupl", r"eupl", "eupl", ("1.0", "1.1", "1.2")),
        ("artistic", r"(?:perl )?artistic license", "artistic", ("1.0", "2.0")),
        ("afl", r"academic free license", "academic free", ("1.1", "1.2", "2.0", "2.1", "3.0")),
        ("osl", r"open software license", "open software", ("1.0", "1.1", "2.0", "2.1", "3.0")),
        ("ofl", r"(?:sil )?open font license", "open font", ("1.0", "1.1")),
        ("odbl", r"(?:odc )?open database license", "open database", ("1.0",)),
        ("odc-by", r"(?:open data commons|odc) attribution license", "attribution license", ("1.0",)),
        ("boost", r"boost software license", "boost", ("1.0",)),
        ("cecill", r"cecill", "cecill", ("1.0", "1.1", "2.0", "2.1")),
        ("lppl", r"latex project public license", "latex project", ("1.0", "1.1", "1.2", "1.3")),
        ("zpl", r"zope public license", "zope", ("1.0", "1.1", "2.0", "2.1")),
        ("php", r"php license", "php", ("3.0", "3.01")),
        ("python", r"(?:python software foundation|psf) license", "license", ("2.0",)),
        ("qpl", r"q public license", "q public", ("1.0",)),
        ("ms-pl", r"microsoft public license", "microsoft", ("1.0",)),
        ("ecl", r"educational community license", "educational community", ("1.0", "2.0")),
        ("bsl", r"business source license", "business source", ("1.0", "1.1")),
        ("sspl", r"server side public license", "server side", ("1.0",)),
        ("ogl", r"open government licen[sc]e", "open government", ("1.0", "2.0", "3.0")),
        ("w3c", r"w3c (?:software )?(?:notice and )?license", "w3c", ("1.0",)),
        ("nposl", r"non profit open software license", "open software", ("3.0",)),
        ("rpl", r"reciprocal public license", "reciprocal public", ("1.1", "1.5")),
        ("upl", r"universal permissive license", "universal permissive", ("1.0",)),
        ("watcom", r"sybase open watcom public license", "watcom", ("1.0",)),
        ("apsl", r"apple public source license", "apple public", ("1.0", "1.1", "1.2", "2.0")),
        ("ipl", r"ibm public license", "ibm public", ("1.0",)),
        ("ngpl", r"nethack general public license", "nethack", ("1.0",)),
        ("spl", r"sun public license", "sun public", ("1.0",)),
        ("vsl", r"vovida software license", "vovida", ("1.0",)),
        ("zlib", r"zlib license", "zlib", ("1.0",)),
    ]
    for label, name, keyword, versions in versioned:
        for version in versions:
            major, minor = version.split(".")
            number = major if minor == "0" else f"{major} {minor}"
            tail = rf"(?: {minor})?" if minor == "0" else rf" {minor}"
            add(f"{label}-{number.replace(' ', '.')}", _licensed(rf"(?:{name})(?:(?: version| v| ver)? | v){major}{tail}") + r"(?: or (?:\w+ ){0,4}later(?: version)?)?", keyword, EXACT, 0.98)
            add(f"{label}-{number.replace(' ', '.')}", _licensed(rf"version {major}{tail} of the (?:{name})"), keyword, EXACT, 0.95)
        add(label, _licensed(name) if " " in name else rf"licensed under (?:the )?(?:{name})", keyword, NAMED, 0.85)

    for short, majors in (("gpl", "123"), ("lgpl", "23"), ("agpl", "13")):
        for major in majors:
            add(f"{short}-{major}", _licensed(rf"(?:gnu )?{short}v{major}") + r"(?: or (?:\w+ ){0,4}later(?: version)?)?", f"{short}v{major}", EXACT, 0.98)

    attribution = {"by": "attribution", "by-sa": "attribution share(?: )?alike", "by-nc": "attribution non(?: )?commercial", "by-nd": "attribution no(?: )?deriv(?:ative)?s?(?: works)?", "by-nc-sa": "attribution non(?: )?commercial share(?: )?alike", "by-nc-nd": "attribution non(?: )?commercial no(?: )?deriv(?:ative)?s?(?: works)?"}
    for kind, words in attribution.items():
        short = f"cc {kind.replace('-', ' ')}"
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            number = version.replace(".", " ")
            add(f"cc-{kind}-{version}", _licensed(rf"{short} {number}(?: international| unported)?"), "cc by", EXACT, 0.98)
            add(f"cc-{kind}-{version}", _licensed(rf"creative commons {words} {number}(?: international| unported)?(?: license)?"), "creative commons", EXACT, 0.98)
        add(f"cc-{kind}", _licensed(short), "cc by", NAMED, 0.85)
        add(f"cc-{kind}", _licensed(rf"creative commons {words}(?: license)?"), "creative commons", NAMED, 0.85)
    for pattern, keyword in (("cc0(?: 1 0)?(?: universal)?", "cc0"), ("cc zero", "cc zero"), ("creative commons zero", "creative commons"), ("creative commons public domain dedication", "creative commons")):
        add("cc0", _licensed(pattern), keyword, EXACT, 0.95)
    for count, words in ((0, "zero"), (1, "one"), (2, "two"), (3, "three"), (4, "four")):
        add(f"bsd-{count}-clause", _licensed(rf"(?:{count}|{words}) clause bsd(?: license)?"), "bsd", EXACT, 0.95)
        add(f"bsd-{count}-clause", _licensed(rf"bsd (?:{count}|{words}) clause(?: license)?"), "bsd", EXACT, 0.95)
    add("bsd-3-clause", _licensed(r"(?:new|modified|revised) bsd license"), "bsd", EXACT, 0.9)
    for word in ("simplified", "freebsd"):
        add("bsd-2-clause", _licensed(rf"{word} (?:bsd )?license"), word, EXACT, 0.9)
    named = [
        ("mit", r"(?:mit|expat|x11) license", "license"), ("mit", r"mit licensed", "licensed"), ("bsd", r"(?:bsd|berkeley) (?:style )?license", "license"),
        ("isc", r"isc license", "license"), ("unlicense", r"unlicense", "unlicense"), ("wtfpl", r"wtfpl", "wtfpl"), ("zlib", r"zlib libpng license", "zlib"),
        ("ncsa", r"university of illinois (?:ncsa )?open source license", "illinois"), ("postgresql", r"postgresql licen[sc]e", "postgresql"),
        ("openssl", r"openssl license", "openssl"), ("ruby", r"ruby license", "ruby"), ("vim", r"vim license", "vim"), ("perl", r"same terms as perl(?: itself)?", "perl"),
        ("ijg", r"independent jpeg group", "jpeg"), ("curl", r"curl license", "curl"), ("ftl", r"freetype (?:project )?license", "freetype"), ("icu", r"icu license", "icu"),
        ("ms-rl", r"microsoft reciprocal license", "microsoft"), ("beerware", r"beerware license", "beerware"), ("json", r"shall be used for good not evil", "not evil"),
        ("public-domain", r"(?:dedicated to|in|into) the public domain", "public domain"), ("public-domain", r"public domain dedication", "public domain"),
        ("pddl", r"public domain dedication and license", "public domain"), ("creative-commons", r"creative commons(?: license)?", "creative commons"),
        ("gpl", r"gnu (?:gpl|public license)", "gnu"), ("copyleft", r"copyleft", "copyleft"), ("proprietary", r"proprietary (?:and confidential|software|license)", "proprietary"),
    ]
    for label, pattern, keyword in named:
        add(label, _licensed(pattern), keyword, NAMED, 0.85)
    notices = [
        ("reserved", r"all rights (?:are )?reserved", "reserved"), ("reserved", r"(?:some|no) rights reserved", "reserved"), ("copyright", r"copyright(?: c)?(?: \d{4})+", "copyright"),
        ("copyright", r"copyright(?: material)?", "copyright"), ("copyright", r"copyrighted(?: material)?", "copyrighted"), *(("no-copying", rf"(?:unauthori[sz]ed|no) {w}", w) for w in ("copying", "reproduction")),
        *(("no-copying", rf"may not be (?:\w+ or )?{w}", w) for w in ("copied", "reproduced", "redistributed")), ("no-copying", r"no part of this (?:publication|work|book) may be", "no part of this"),
        ("permission", r"permission is hereby granted free of charge", "hereby granted"), ("permission", r"redistribution and use in source and binary forms", "redistribution"),
        ("permission", r"reprinted with (?:the )?permission", "permission"), ("permission", r"used (?:with|by) permission", "permission"), ("no-warranty", r"without warranty of any kind", "warranty"),
        ("no-warranty", r"(?:provided )?as is without (?:express or implied )?warranty", "warranty"), *(("licensed", rf"{w} (?:under|to|by)", w) for w in ("licensed", "licenced")), *(("licensed", rf"(?:subject to|terms of) (?:the |this )?{w}", w) for w in ("license", "licence")),
        *(("trademark", rf"(?:registered )?{w} of", w) for w in ("trademark", "trademarks")), ("confidential", r"(?:strictly )?confidential(?: information)?", "confidential"), ("terms", r"terms (?:and conditions|of (?:use|service))", "terms"),
    ]
    for label, pattern, keyword in notices:
        add(label, pattern, keyword, NOTICE, 0.5)
    return tuple(out)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NO_WORD = "".join(chr(c) for c in range(0x80) if not chr(c).isalnum())


def words(text: Column) -> Column:
    """Words of a text: runs of digits, A-Z lower-cased, a-z and everything beyond ASCII; null counts as empty."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _NO_WORD, _UPPER.lower() + " " * len(_NO_WORD))
    return F.array_remove(F.split(plain, " "), "")


def _rule_table() -> Column:
    """All rules as one struct of arrays, each split from one string: the optimizer folds it into a single literal."""
    table = rules()

    def column(values, kind="string"):
        return F.split(F.lit("\n".join(map(str, values))), "\n").cast(f"array<{kind}>")

    return F.struct(
        column(f" {r.keyword} " for r in table).alias("keyword"), column(f"(?<= )(?:{r.pattern})(?= )" for r in table).alias("pattern"), column((r.priority for r in table), "int").alias("priority"),
        column(r.label for r in table).alias("label"), column((r.confidence for r in table), "double").alias("confidence"),
    )


def _places(phrase: str) -> Column:
    """Word indices at which the phrase's words stand consecutively."""
    own = phrase.split()
    at = "sequence(0, size(words) - 1)"
    test = " and ".join(f"get(words, i + {k}) = '{w}'" for k, w in enumerate(own))
    none = "cast(array() as array<int>)"
    return F.expr(f"case when contains(line, ' {phrase} ') then filter({at}, i -> coalesce({test}, false)) else {none} end")


#: Matches of one rule as (begin, end) in the line, from the pieces between them.
_MATCHES = """
aggregate(
  zip_with(regexp_extract_all(line, get(rules.pattern, r), 0), slice(split(line, get(rules.pattern, r)), 1, size(regexp_extract_all(line, get(rules.pattern, r), 0))), (m, gap) -> struct(length(gap) as gap, length(m) as size)),
  named_struct('at', 0, 'found', cast(array() as array<struct<begin:int,back:int,priority:int,rank:int,label:string,confidence:double>>)),
  (acc, x) -> named_struct('at', acc.at + x.gap + x.size, 'found', array_append(acc.found, named_struct('begin', acc.at + x.gap, 'back', -(acc.at + x.gap + x.size), 'priority', get(rules.priority, r), 'rank', r, 'label', get(rules.label, r), 'confidence', get(rules.confidence, r)))),
  acc -> acc.found)
"""
_DETECTED = f"array_sort(flatten(transform(filter(sequence(0, size(rules.keyword) - 1), r -> contains(line, get(rules.keyword, r))), r -> {_MATCHES})))"
#: Detections come by begin, longest first: one is within an earlier one of at most its priority number if it ends by that one's end.
_KEPT = """
aggregate(detected,
  named_struct('e1', -1, 'e2', -1, 'e3', -1, 'labels', cast(array() as array<string>), 'score', 0.0D),
  (acc, d) -> case when -d.back <= case d.priority when 1 then acc.e1 when 2 then acc.e2 else acc.e3 end then acc
    else named_struct(
      'e1', if(d.priority <= 1, greatest(acc.e1, -d.back), acc.e1),
      'e2', if(d.priority <= 2, greatest(acc.e2, -d.back), acc.e2),
      'e3', greatest(acc.e3, -d.back),
      'labels', array_union(acc.labels, array(d.label)),
      'score', greatest(acc.score, d.confidence)) end)
"""


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    ``labels`` holds the base labels and those of the detections kept, the
    score is the highest confidence of these (1 for base phrases).  Texts that
    are null or empty have no words; repeated rows stay, other columns are
    ignored.
    """
    found = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("words"))
    # A text without the longest word of any keyword or base phrase has no detection.
    gates = sorted({max(k.split(), key=len) for k in [*(r.keyword for r in rules()), *BASE]})
    may = F.arrays_overlap("words", F.array(*map(F.lit, gates)))
    found = found.withColumn("line", F.when(may, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))))
    places = [F.coalesce(_places(p), F.expr("cast(array() as array<int>)")).alias(f"p{i}") for i, p in enumerate(BASE)]
    found = found.withColumn("rules", F.when(F.col("line").isNotNull(), _rule_table()))
    found = found.select("doc_id", F.size("words").cast("long").alias("n_words"), *places, F.expr(f"case when line is not null then {_DETECTED} end").alias("detected"))
    all_places = F.concat(*[F.col(f"p{i}") for i in range(len(BASE))])
    base = F.concat(*[F.when(F.size(f"p{i}") > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for i, label in enumerate(BASE.values())])
    found = found.select("doc_id", "n_words", all_places.alias("places"), F.array_sort(base).alias("base"), F.expr(f"case when size(detected) > 0 then {_KEPT} end").alias("kept"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("kept.labels", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("kept.score", F.lit(0.0))).alias("score"),
    )


def license_sql() -> str:
    """DuckDB SQL of license_scan() on the documents.

    Its regular expressions have no look-around: spaces are doubled, so that
    each match can take one on either side.
    """
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    double = lambda x: x.replace(" ", "  ")
    values = ", ".join(f"({i}, {quote(f'  {double(r.keyword)}  ')}, {quote(f' (?:{double(r.pattern)}) ')}, {r.priority}, {quote(r.label)}, {r.confidence}::DOUBLE)" for i, r in enumerate(rules()))
    places = {label: f"list_filter(range(0, len(words)), lambda i: {' AND '.join(f'words[i + {k}] = {quote(w)}' for k, w in enumerate(phrase.split(), 1))})" for phrase, label in BASE.items()}
    base = " || ".join(f"CASE WHEN len({p}) > 0 THEN [{quote(label)}] ELSE [] END" for label, p in places.items())
    return f"""
WITH rules(rank, keyword, pattern, priority, label, confidence) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
p AS (SELECT *, '  ' || array_to_string(words, '  ') || '  ' AS line, {" || ".join(places.values())} AS places, list_sort({base}) AS base FROM d),
m AS (SELECT n, rank, priority, label, confidence, regexp_extract_all(line, pattern) AS found, regexp_split_to_array(line, pattern) AS gaps FROM p JOIN rules ON contains(line, keyword)),
k AS (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM m),
t AS (SELECT n, rank, priority, label, confidence, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k-1], lambda x: length(x))), 0) AS a, length(found[k]) AS size FROM k),
i AS (SELECT n, rank, priority, label, confidence, a, a + size AS z FROM t),
kept AS (SELECT * FROM i x WHERE NOT EXISTS (SELECT 1 FROM i e WHERE e.n = x.n AND e.z >= x.z AND e.priority <= x.priority AND (e.a < x.a OR e.a = x.a AND (e.z > x.z OR e.z = x.z AND (e.priority < x.priority OR e.priority = x.priority AND e.rank < x.rank))))),
own AS (SELECT n, list(DISTINCT label) AS labels, max(confidence) AS score FROM kept GROUP BY n)
SELECT doc_id, len(words)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word, array_to_string(base, ',') AS base_labels,
array_to_string(list_sort(list_distinct(base || coalesce(labels, []))), ',') AS labels, CASE WHEN len(base) > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score FROM p LEFT JOIN own USING (n)"""
