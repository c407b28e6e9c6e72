"""Scalar expressions over names, paths and descriptions; all are built-in Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordinal words of levels, and the level ranges of tiers.
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth"]
TIERS = {1: (1, 4), 2: (5, 10), 3: (11, 16), 4: (17, 20)}


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# fixed values: the patterns of file names and the words of drafts, below


def version_flags(name: Column) -> list[Column]:
    """is_old_version and version_generation from a suffix such as ``.old-002.pdf``."""
    old = name.rlike(r"(?i)\.old(-\d+)?\.pdf$")
    number = extract(name, r"(?i)\.old-(\d+)\.pdf$")
    return [old.alias("is_old_version"), F.when(old, F.coalesce(number.cast("int"), F.lit(0))).alias("version_generation")]


def product_code(name: Column) -> list[Column]:
    """product_id (digits before the first hyphen) and product_version (in parentheses, else after a space or _)."""
    inside = extract(name, r"(?i)\((v[\d._]+)[^)]*\)")
    outside = extract(name, r"(?i)[_\s](v\d+[._]\d+(\.\d+)?)")
    return [extract(name, r"^(\d{4,})-").alias("product_id"), F.coalesce(inside, outside).alias("product_version")]


def draft_flags(name: Column) -> list[Column]:
    """is_draft by keyword between separators, is_duplicate by a download suffix such as `` (1).pdf``."""
    words = "draft|preview|playtest|play[_\\s]test|beta|wip|proof|alpha|ashcan|pre[_-]?release|early[_\\s]release"
    return [name.rlike(rf"(?i)(^|[_\s.-])({words})([_\s.-]|$)").alias("is_draft"), name.rlike(r"(?i)\s*\(\d+\)\.pdf$").alias("is_duplicate")]


def folder_parts(path: Column) -> list[Column]:
    """publisher and collection from a relative path: its first folder, and the folders between that and the file."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return [F.when(n > 1, parts[0]).alias("publisher"), F.when(n > 2, F.array_join(F.slice(parts, 2, F.greatest(n - 2, F.lit(0))), "/")).alias("collection")]


def container(path: Column, depth: int) -> list[Column]:
    """bucket and bucket_depth: the folder of a file, cut at ``depth``."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    n = F.least(F.lit(depth), F.greatest(F.size(parts) - 1, F.lit(0)))
    return [F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")).alias("bucket"), n.alias("bucket_depth")]


def human_bytes(size: Column) -> Column:
    """A size with one decimal; halves go to the even digit, as C's printf has them."""
    steps = [(1 << 40, "TB"), (1 << 30, "GB"), (1 << 20, "MB"), (1 << 10, "KB")]
    named = [(size >= n, F.concat(F.format_string("%.1f", F.bround(size / n, 1)), F.lit(" " + u))) for n, u in steps]
    first, *rest = named
    ladder = reduce(lambda c, x: c.when(*x), rest, F.when(*first))
    return ladder.otherwise(F.concat(size.cast("string"), F.lit(" B")))


def near_name(name: Column) -> Column:
    """A key that copies of a file share: lower case, no ``copy of``, ``(1)`` or ``- copy``, single spaces."""
    low = F.lower(name)
    ext = F.regexp_extract(low, r"[^.](\.[^.]*)$", 1)
    root = F.substring(low, F.lit(1), F.length(low) - F.length(ext))
    for pattern in (r"^copy of\s+", r"\s*\(\d+\)$", r"\s*-\s*copy$"):
        root = F.regexp_replace(root, pattern, "")
    return F.concat(strip(F.regexp_replace(root, r"\s+", " ")), ext)


def decoded_path(path: Column) -> Column:
    """Percent-decoded; a plus sign stays, and a path that isn't well formed stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def group_key(publisher: Column, collection: Column, key: Column) -> Column:
    """Publisher and collection, folded; a row without a collection is a group of its own."""
    norm = F.replace(F.replace(F.replace(collection, F.lit("–"), F.lit("-")), F.lit("—"), F.lit("-")), F.lit("  "), F.lit(" "))
    pair = F.concat(F.lower(strip(F.coalesce(publisher, F.lit("")))), F.lit("||"), F.lower(strip(norm)))
    return F.when(F.coalesce(collection, F.lit("")) == "", F.concat(F.lit("id:"), key.cast("string"))).otherwise(pair)


def normal_series(series: Column, aliases: dict[str, str] | None = None) -> Column:
    """Dashes and spaces made alike, trailing punctuation dropped, one alias looked up; empty is null."""
    s = F.regexp_replace(F.regexp_replace(series, "[–—]", "-"), r"\s+", " ")
    s = F.nullif(strip(F.regexp_replace(strip(s), r"[\s:,\-]+$", "")), F.lit(""))
    if not aliases:
        return s
    return F.coalesce(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[s], s)


def _levels(lo: Column, hi: Column) -> Column:
    """Both bounds, the smaller first, where both lie in 1 to 30."""
    return F.when(lo.between(1, 30) & hi.between(1, 30), F.struct(F.least(lo, hi).alias("min_level"), F.greatest(lo, hi).alias("max_level")))


def level_range(description: Column) -> Column:
    """A struct of min_level and max_level from prose: ordinal words, ``3rd-5th level``, ``levels 3-5``, ``level 3``, tier.

    Of ordinal words the one that comes first in their own order decides, as a range where another follows it before
    ``level``, else alone; then numbers, then tiers. Bounds out of 1 to 30 give nulls.
    """
    d = F.lower(description)
    ordinal = "|".join(ORDINALS)
    place = F.create_map(*[F.lit(x) for i, w in enumerate(ORDINALS) for x in (w, i + 1)])
    # every mention as a struct, sorted by its first word; a range before a single level of the same word
    starts = F.regexp_extract_all(d, F.lit(rf"\b({ordinal})(?=[-\s]*(?:to[-\s]*)?(?:{ordinal})[-\s]*level)"), 1)
    stops = F.regexp_extract_all(d, F.lit(rf"\b(?:{ordinal})(?=[-\s]*(?:to[-\s]*)?({ordinal})[-\s]*level)"), 1)
    pairs = F.filter(F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda x: F.struct(place[x["a"]].alias("lo"), F.lit(0).alias("alone"), place[x["b"]].alias("hi"))), lambda x: x["lo"] != x["hi"])
    alone = F.transform(F.regexp_extract_all(d, F.lit(rf"\b({ordinal})[-\s]level"), 1), lambda w: F.struct(place[w].alias("lo"), F.lit(1).alias("alone"), place[w].alias("hi")))
    first = F.array_min(F.concat(pairs, alone))
    number = lambda p, g: extract(d, p, g).try_cast("int")
    suffix, dash = "(?:st|nd|rd|th)?", r"\s*[-–]\s*"
    forms = [rf"(\d+){suffix}{dash}(\d+){suffix}\s+level", rf"levels?\s+(\d+)(?:{dash}(\d+))?"]
    found = F.when(first.isNotNull(), _levels(first["lo"], first["hi"]))
    for p in forms:
        found = found.when(d.rlike(p), _levels(number(p, 1), F.coalesce(number(p, 2), number(p, 1))))
    tier = extract(d, r"\btier\s+([1-4])\b").cast("int")
    bounds = F.array(*[F.struct(F.lit(lo).alias("min_level"), F.lit(hi).alias("max_level")) for lo, hi in TIERS.values()])
    found = found.when(tier.isNotNull(), F.try_element_at(bounds, tier))
    return F.coalesce(found, F.struct(F.lit(None).cast("int").alias("min_level"), F.lit(None).cast("int").alias("max_level")))


def keywords(question: Column, most: int = 12) -> Column:
    """The first words of a question, without punctuation, as search terms."""
    clean = strip(F.regexp_replace(question, r"(?U)[^\w\s]", " "))
    return F.array_join(F.slice(F.split(clean, r"\s+"), 1, most), " ")


def preview(text: Column, most: int = 240) -> Column:
    """Without tags, white space squeezed, cut with an ellipsis."""
    plain = strip(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"\s+", " "))
    return F.when(F.length(plain) > most, F.concat(F.substring(plain, 1, most - 1), F.lit("…"))).otherwise(plain)


def joined_lines(text: Column) -> Column:
    """Words hyphenated across line ends put together."""
    return F.regexp_replace(text, r"(\w)-\n(\w)", "$1$2")


def safe_name(text: Column) -> Column:
    """A file name without characters that file systems refuse."""
    return F.substring(strip(F.regexp_replace(text, r'[<>:"/\\|?*]', "-")), 1, 200)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def balanced(text: Column) -> Column:
    """Whether braces close in order."""
    chars = F.filter(F.split(text, ""), lambda c: c.isin("{", "}"))
    start = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok"))
    step = lambda a, c: F.struct((a["depth"] + F.when(c == "{", 1).otherwise(-1)).alias("depth"), (a["ok"] & (a["depth"] + F.when(c == "{", 1).otherwise(-1) >= 0)).alias("ok"))
    return F.aggregate(chars, start, step, lambda a: a["ok"] & (a["depth"] == 0))


def token_overlap(a: Column, b: Column, stopwords: list[str]) -> Column:
    """Shared words by the larger set, stopwords left out; 0 where a side has none."""
    return word_overlap(word_set(a, stopwords), word_set(b, stopwords))


def word_set(c: Column, stopwords: list[str]) -> Column:
    """The different words of a text, stopwords left out."""
    return F.array_except(F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != "")), F.array(*[F.lit(w) for w in stopwords]))


def word_overlap(a: Column, b: Column) -> Column:
    """Shared words of two sets by the larger one; 0 where a side has none."""
    most, either = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / most).otherwise(F.lit(0.0))


def number_cell(cell: Column) -> Column:
    """A whole number, null for anything else."""
    return strip(cell.cast("string")).try_cast("int")


def right_of_slash(cell: Column) -> Column:
    """The number right of the first slash of a cell such as ``15 / 18``, or the number it is without one."""
    s = cell.cast("string")
    at = F.instr(s, "/")
    return number_cell(F.when(at > 0, F.substring(s, at + 1, F.length(s))).otherwise(s))


def compressed(label: Column) -> Column:
    """Lower case without spaces, underscores and hyphens; null for an empty label."""
    return F.nullif(F.regexp_replace(F.lower(strip(label.cast("string"))), r"[ _-]", ""), F.lit(""))


def canonical_label(label: Column, aliases: dict[str, str]) -> Column:
    """The name that ``aliases`` (compressed label to name) gives, null for labels that it hasn't."""
    return F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[compressed(label)]


def display_name(key: Column, names: dict[str, str]) -> Column:
    """The name shown for a key, the key itself where none is given, empty for null."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[key], key, F.lit(""))


def season(name: Column) -> Column:
    """The season number in a file's name: two digits after one product code (4 to 11), else one or two after an older one
    (1 to 3); null without either."""
    late = extract(name, r"(?i)ddal[\s_-]*(\d{2})").try_cast("int")
    early = extract(name, r"(?i)ddex[\s_-]*0?(\d)").try_cast("int")
    return F.coalesce(F.when(late.between(4, 11), late), F.when(early.between(1, 3), early))


def wikilink(text: Column) -> Column:
    """A link to the page of that name, by the name that the file has."""
    return F.concat(F.lit("[["), safe_name(text), F.lit("]]"))


def document_id(url: Column) -> Column:
    """The id of a document in an address: what follows ``/d/``, an ``id`` parameter, or the address itself if it is one."""
    return F.coalesce(extract(url, r"/d/([A-Za-z0-9_-]{10,})"), extract(url, r"[?&]id=([A-Za-z0-9_-]{10,})"), extract(url, r"^([A-Za-z0-9_-]{10,})$"))


def escaped_markdown(text: Column) -> Column:
    """With backslashes before the characters that Markdown would read as marks."""
    return F.regexp_replace(text, r"([\\`*_{}\[\]<>#|])", r"\\$1")


def without_fence(text: Column) -> Column:
    """The inside of a fenced code block; other texts as they are, white space at the ends dropped."""
    return F.trim(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\n?|\n?```$", ""))


def range_cell(cell: Column) -> Column:
    """A struct lo, hi of a cell such as ``01-30`` or ``45``; 0 is 100; dashes, n/a and blanks are null."""
    s = F.regexp_replace(strip(cell.cast("string")), "[–—]", "-")
    hundred = lambda c: F.when(c == 0, F.lit(100)).otherwise(c)
    lo = hundred(extract(s, r"^(\d+)\s*(?:-\s*\d+)?$").try_cast("int"))
    hi = hundred(extract(s, r"^\d+\s*-\s*(\d+)$").try_cast("int"))
    return F.when(lo.isNotNull(), F.struct(lo.alias("lo"), F.coalesce(hi, lo).alias("hi")))


def sectioned_page(title: Column, sections: list[tuple[str, Column]]) -> Column:
    """A Markdown page: the title, then a heading and a list for each section (name, array of lines) that has lines."""
    lists = [F.when(F.size(lines) > 0, F.concat(F.lit(f"## {name}\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n"))) for name, lines in sections]
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), *lists)
