"""Text functions as Column expressions; HTML, which needs a parser, as an Arrow function."""

import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Polish letters and their plain forms.
POLISH = ("ąćęłńóśźż", "acelnoszz")
#: Administrative words before a place's name.
PLACE_PREFIX = r"^(?:m\.|m\.st\.|miasto|gmina|gm\.|powiat|pow\.|woj\.|wojewodztwo)\s+"
#: Words before a street's name, and what is not a street.
STREET_PREFIX = r"(?iu)^(?:ul|ulica|al|aleja|aleje|pl|plac|rondo|skwer|bulwar)\.?\s+"
NOT_A_STREET = r"(?iuU)^(?:os|osiedle|rynek)\b"
#: Fixed value: what stands in place of a text that its owner withholds.
MASK = "***"


def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks whose decomposition is one plain letter with marks."""
    found = []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(cp):
            found.append((chr(cp), plain))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def normalize_name(c: Column) -> Column:
    """Lower case, Polish and other accented letters made plain, combining marks dropped. Null stays null."""
    accents = _accents()
    plain = F.translate(F.translate(F.lower(c), *POLISH), *accents)
    return F.regexp_replace(plain, r"[̀-ͯ]", "")


def slug(c: Column) -> Column:
    return F.replace(F.coalesce(normalize_name(c), F.lit("")), F.lit(" "), F.lit("-"))


def place_name(c: Column) -> Column:
    """A comparable name of a place: normalised, single-spaced, without one administrative prefix; null if nothing is left."""
    squeezed = F.regexp_replace(F.trim(normalize_name(c)), r"(?U)\s+", " ")
    return F.nullif(F.regexp_replace(squeezed, PLACE_PREFIX, ""), F.lit(""))


def is_masked(c: Column) -> Column:
    return F.coalesce(F.trim(c) == MASK, F.lit(False))


def street_key(c: Column) -> Column:
    """The last telling word of a street's name, by which spellings of one street agree; null for estates, squares and masks."""
    street = F.trim(c)
    words = F.split(F.trim(F.regexp_replace(normalize_name(F.regexp_replace(street, STREET_PREFIX, "")), "[^a-z0-9]+", " ")), " ")
    telling = F.filter(words, lambda w: (F.length(w) > 2) & ~w.rlike(r"^\d+$"))
    return F.when(street.rlike(NOT_A_STREET) | is_masked(c) | (street == ""), F.lit(None).cast("string")).otherwise(F.get(telling, F.size(telling) - 1))


def register_street(c: Column) -> Column:
    """The street in a register's address (UL:name;...), as street_key."""
    return street_key(F.nullif(F.regexp_extract(c, "UL:([^;]+)", 1), F.lit("")))


def plain_text(c: Column) -> Column:
    """Without tags, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"(?U)\s+", " "))


def joined_text(*parts: Column) -> Column:
    """plain_text of the parts that are not empty, one after the other."""
    return plain_text(F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts)))


def humanize(c: Column) -> Column:
    plain = F.trim(F.replace(c, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(plain, 1, 1)), F.lower(F.substring(plain, 2, 1_000_000)))


def camel_words(c: Column) -> Column:
    return F.trim(F.replace(F.regexp_replace(c, "(?<=[a-ząćęłńóśźż0-9])(?=[A-ZĄĆĘŁŃÓŚŹŻ])", " "), F.lit("_"), F.lit(" ")))


def last_segment(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def contains_ci(c: Column, text: str) -> Column:
    """Whether c holds the text, whatever the case, with no wildcards: LIKE with all of its signs escaped."""
    return F.contains(F.lower(c), F.lit(text.lower()))


def road_label(ref: Column, name: Column) -> Column:
    """The references of a road, digits alone prefixed with DK, each once, joined by a slash; without any, its name."""
    refs = F.transform(F.split(F.coalesce(ref, F.lit("")), ";"), lambda r: F.replace(F.trim(r), F.lit(" "), F.lit("")))
    told = F.transform(F.filter(refs, lambda r: r != ""), lambda r: F.when(r.rlike(r"^\d+$"), F.concat(F.lit("DK"), r)).otherwise(r))
    return F.coalesce(F.nullif(F.array_join(F.array_distinct(told), "/"), F.lit("")), name)


def trigrams(c: Column) -> Column:
    """The distinct trigrams of a text's words, each word with two blanks before and one behind it."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    each = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; null if a text is null, 0 if neither has any."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0)))


def money(c: Column) -> Column:
    """1234567 as '1 234 567 zł'."""
    return F.concat(F.replace(F.format_number(c, 0), F.lit(","), F.lit(" ")), F.lit(" zł"))


def percent(c: Column) -> Column:
    """-12.5 as '-12,5%', 3.0 as '+3%'."""
    shown = F.regexp_replace(F.format_number(F.abs(c), 1), r"\.0$", "")
    return F.concat(F.when(c < 0, "-").when(c > 0, "+").otherwise(""), F.replace(F.replace(shown, F.lit(","), F.lit("")), F.lit("."), F.lit(",")), F.lit("%"))


def behind(most: int) -> str:
    """A pattern for a look-behind whose group holds the last `most` characters before a match, or all if there are fewer."""
    return rf"(?<=(^.{{0,{most - 1}}}|.{{{most}}}))"


def first_match(content: Column, pattern: str) -> tuple[Column, Column]:
    """Where a pattern is first met (characters before it), and how many characters it takes."""
    return F.regexp_instr(content, F.lit(pattern)) - 1, F.length(F.regexp_substr(content, F.lit(pattern)))


def excerpt(content: Column, at: Column, size: Column, margin: int = 50) -> Column:
    """`size` characters behind the first `at` with about `margin` on each side, out to whole words; an ellipsis where text was cut."""
    cut = lambda start, length: F.substring(content, start + 1, length)
    near, far = F.greatest(at - margin, F.lit(0)), F.least(at + size + margin, F.length(content))
    before, after = cut(F.lit(0), near), cut(far, F.length(content) - far)
    word_before, word_after = F.substring_index(before, " ", -1), F.substring_index(after, " ", 1)
    dots = lambda all_of_it, word: F.when(F.length(word) < F.length(all_of_it), "…").otherwise("")
    return F.concat(dots(before, word_before), F.trim(F.concat(word_before, cut(near, far - near), word_after)), dots(after, word_after))


#: Elements after which a line ends.
BLOCKS = frozenset("p div li ul ol h1 h2 h3 h4 h5 h6 table tr section".split())
#: Elements whose content is no text.
HIDDEN = frozenset("script style template".split())


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "br":
            self.out.append("\n")

    def handle_startendtag(self, tag, attrs):
        if tag == "br" or tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def html_text(html: str | None, most: int | None = None) -> str | None:
    """The text of HTML with line breaks where blocks end; beyond `most` characters cut, with a mark."""
    if not html:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    text = "".join(parser.out)
    while "\n\n\n" in text:
        text = text.replace("\n\n\n", "\n\n")
    text = text.strip()
    if not text:
        return None
    return text if most is None or len(text) <= most else text[:most].rstrip() + "\n[...opis skrócony]"


def html_to_text(c: Column, most: int | None = None) -> Column:
    @F.pandas_udf("string")
    def run(html: pd.Series) -> pd.Series:
        return html.map(lambda x: html_text(x, most), na_action="ignore")

    return run(c)
