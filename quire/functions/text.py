"""Column functions over text.  Each takes and returns a Column and stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Titles of chapters that are not part of the work.
BOILERPLATE_TITLES = (
    "contents", "table of contents", "index", "notes", "end notes", "endnotes", "footnotes", "references", "bibliography", "acknowledgments", "acknowledgements",
    "about the author", "copyright", "colophon", "a note on the type", "illustration permissions", "permissions", "title page", "cover", "dedication", "epigraph", "imprint", "frontispiece",
)
#: Words that do not tell one title from another.  Volume numbers are not among them, so volumes stay apart.
TITLE_NOISE = ("unabridged", "audiobook", "ebook", "hd", "remastered")
#: Words that are no keyword of a question.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "what", "who", "where", "when", "why", "how", "does", "did", "do", "has", "have", "had", "this",
    "that", "these", "those", "it", "its", "in", "on", "at", "to", "for", "of", "with", "by", "from", "about",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fields(text: Column | str) -> Column:
    """Words between ASCII white space, no empty ones (SCA1)."""
    return F.array_remove(F.split(_col(text), r"\s+"), "")


def unicode_fields(text: Column | str) -> Column:
    """Words between any white space of Unicode, no empty ones (SCA1)."""
    return F.array_remove(F.split(_col(text), r"(?U)\s+"), "")


def word_count(text: Column | str) -> Column:
    return F.size(fields(text)).cast("long")


def tokenize(text: Column | str) -> Column:
    """Comparable tokens: lower case, only a-z, 0-9 and inner apostrophes (SCA2)."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(_col(text)), "[‘’]", "'"), "[^a-z0-9' ]+", " ")
    return F.array_remove(F.transform(F.split(plain, " +"), lambda w: F.regexp_replace(w, "^'+|'+$", "")), "")


def display_tokens(text: Column | str) -> Column:
    """The same token boundaries with case kept (SCA3)."""
    plain = F.regexp_replace(F.regexp_replace(_col(text), "[‘’]", "'"), "[^A-Za-z0-9' ]+", " ")
    return F.array_remove(F.transform(F.split(plain, " +"), lambda w: F.regexp_replace(w, "^'+|'+$", "")), "")


def normalize_word(word: Column | str) -> Column:
    """A word in lower case without marks at its ends (SCA4)."""
    return F.regexp_replace(F.lower(F.trim(_col(word))), r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$", "")


def normalize_title(title: Column | str) -> Column:
    """Letters and digits, single spaces, lower case (SCA5)."""
    return F.trim(F.regexp_replace(F.lower(_col(title)), "[^a-z0-9]+", " "))


def title_key(title: Column | str) -> Column:
    """Key under which renderings of one title meet: no bracketed tail, noise or leading article (SCA6)."""
    head = F.regexp_replace(F.lower(_col(title)), r"[(\[{].*$", "")
    plain = F.regexp_replace(head, r"\b(" + "|".join(TITLE_NOISE) + r")\b", " ")
    bare = F.regexp_replace(F.trim(plain), r"^(the|an|a) ", "")
    return F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def author_key(author: Column | str) -> Column:
    """Family name of "First Last" or "Last, First" (SCA7); empty stays empty."""
    a = F.lower(F.trim(_col(author)))
    turned = F.when(F.instr(a, ",") > 0, F.substring_index(a, ",", 1)).otherwise(F.substring_index(a, " ", -1))
    return F.regexp_replace(turned, r"[.,;: ]+$", "")


def word_overlap(a: Column, b: Column, longer_than: int = 2) -> Column:
    """How many words of ``a`` of more than two letters are in ``b`` (SCA10)."""
    return F.size(F.filter(a, lambda x: (F.length(x) > longer_than) & F.array_contains(b, x))).cast("long")


def filing_title(title: Column | str) -> Column:
    """Title for sorting, without a leading article (TOP1)."""
    return F.lower(F.regexp_replace(_col(title), "^(?i)(the|an|a) ", ""))


def is_boilerplate(title: Column | str) -> Column:
    """Whether a chapter title is front or back matter (FIL10)."""
    t = F.lower(F.trim(_col(title)))
    return t.isin(*BOILERPLATE_TITLES) | t.contains("project gutenberg")


def sentences(text: Column | str) -> Column:
    """Sentences that end at . ! ? or a line break, marks kept (SEG4)."""
    cut = F.split(F.regexp_replace(_col(text), r"([.!?])", "$1\n"), r"\n")
    return F.array_remove(F.transform(cut, lambda s: F.trim(s)), "")


def ends_sentence(text: Column | str) -> Column:
    return _col(text).rlike("[.!?][\"')”’]*$")


def keyword(text: Column | str) -> Column:
    """The longest word of over two characters that is not a stop word, the first of equals; the text itself if none (SCA29)."""
    words = F.transform(fields(F.lower(_col(text))), lambda w: F.regexp_replace(w, "^[?.,!;:'\"]+|[?.,!;:'\"]+$", ""))
    good = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    best = F.aggregate(good, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    return F.when(best == "", _col(text)).otherwise(best)


def is_pure_repetition(words: Column, least: int = 4) -> Column:
    """Whether a word list is its own beginning several times over (SCA28): it is then found in its double before the second copy."""
    s = F.concat(F.lit(" "), F.array_join(words, " "))
    return (F.size(words) >= least) & (F.instr(F.substr(F.concat(s, s), F.lit(2)), s) < F.length(s))


def snippet(text: Column, at: Column, length: Column, around: int = 50) -> Column:
    """Text near a match that starts at character ``at`` (from 1), with dots where it is cut (SCA41)."""
    start = F.greatest(at - around, F.lit(1))
    stop = F.least(at + length + around - 1, F.length(text))
    body = F.substring(text, start, stop - start + 1)
    return F.concat(F.when(start > 1, F.lit("...")).otherwise(""), body, F.when(stop < F.length(text), F.lit("...")).otherwise(""))


def session_title(text: Column | str, most: int = 60) -> Column:
    """Title of a conversation from its first message (SCA43); characters, not bytes."""
    flat = F.trim(F.regexp_replace(_col(text), r"\s+", " "))
    return F.when(flat == "", "New chat").when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most)), F.lit("…"))).otherwise(flat)


def excerpt(text: Column | str, most: int = 150) -> Column:
    """The first characters of a text (SCA42)."""
    return F.when(F.length(_col(text)) > most, F.concat(F.left(_col(text), F.lit(most)), F.lit("..."))).otherwise(_col(text))


#: References to characters of HTML that occur in plain pages.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&"))
BLOCK_END = r"(?i)</(p|div|h[1-6]|li|tr|blockquote|section|article|nav|ul|ol|footer|header|table)>|<br\s*/?>"


def html_to_text(html: Column | str) -> Column:
    """Lines of text of a page: no head, scripts, styles or tags; blank lines dropped (SCA23)."""
    h = F.regexp_replace(_col(html), r"(?is)<(head|script|style)\b.*?</(head|script|style)>", "")
    h = F.regexp_replace(h, r"(?is)<!--.*?-->|<su[pb]\b[^>]*>.*?</su[pb]>", "")
    h = F.regexp_replace(F.regexp_replace(h, BLOCK_END, "\n"), r"(?s)<[^>]*>", "")
    for name, char in ENTITIES:
        h = F.replace(h, F.lit(name), F.lit(char))
    lines = F.transform(F.split(h, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " ")))
    return F.array_join(F.array_remove(lines, ""), "\n")


def headings(html: Column | str) -> Column:
    """Text of the headings of a page in order (SCA27)."""
    found = F.regexp_extract_all(_col(html), F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), 1)
    return F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"(?s)<[^>]*>", "")))


def sanitize_html(html: Column | str) -> Column:
    """Tags of a short list without attributes; all others go, and scripts go with their content (SCA24)."""
    h = F.regexp_replace(_col(html), r"(?is)<(head|script|style)\b.*?</(head|script|style)>", "")
    h = F.regexp_replace(h, r"(?is)<!--.*?-->|<!doctype[^>]*>", "")
    h = F.regexp_replace(h, r"(?is)<(/?)(p|br|b|i|em|strong|h[1-6]|ul|ol|li|blockquote)(\s[^>]*)?/?>", "\u0001$1$2\u0002")
    h = F.regexp_replace(h, r"(?s)<[^>]*>", "")
    return F.translate(h, "\u0001\u0002", "<>")


def roman_value(numeral: Column | str) -> Column:
    """Value of a Roman numeral in capitals (SCA16); null for anything else."""
    n = _col(numeral)
    values = F.create_map(*[F.lit(x) for p in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in p])
    digits = F.transform(F.split(n, ""), lambda c: F.try_element_at(values, c))
    signed = F.transform(digits, lambda v, i: F.when(v < F.coalesce(F.get(digits, i + 1), F.lit(0)), -v).otherwise(v))
    return F.when(n.rlike("^[IVXLCDM]+$"), F.aggregate(signed, F.lit(0), lambda a, v: a + v))


_UNITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
_TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")


def number_word(word: Column | str) -> Column:
    """Value of digits or of an English number word up to ninety-nine (SCA14); null for anything else."""
    w = F.lower(F.trim(_col(word)))
    pairs = [(u, i) for i, u in enumerate(_UNITS)] + [(t, 10 * i) for i, t in enumerate(_TENS, 2)]
    values = F.create_map(*[F.lit(x) for p in pairs for x in p])
    parts = F.split(w, "[- ]+")
    both = F.try_element_at(values, F.get(parts, 0)) + F.try_element_at(values, F.get(parts, 1))
    tens = F.get(parts, 0).isin(*_TENS) & F.get(parts, 1).isin(*_UNITS[1:10])
    return F.when(w.rlike("^[0-9]{1,3}$"), F.expr("0") + w.try_cast("int")).when(F.size(parts) == 1, F.try_element_at(values, w)).when((F.size(parts) == 2) & tens, both)


def chapter_number(title: Column | str) -> Column:
    """Number of "Chapter 7", "Ch. 7" or a title that ends in "Part XII" (SCA16); null if none."""
    t = _col(title)
    arabic = F.nullif(F.regexp_extract(t, r"(?i)(?:chapter|ch\.?|letter|part)\s*(\d+)", 1), F.lit("")).try_cast("int")
    roman = roman_value(F.upper(F.nullif(F.regexp_extract(t, r"(?i)(?:chapter|ch\.?|part)\s+([ivx]+)$", 1), F.lit(""))))
    return F.coalesce(arabic, roman)


def series_of(title: Column | str) -> Column:
    """(name, index) of "Name, Book 3", "Name #3" or "Book 3 of Name" (SRC7); nulls if none."""
    t = _col(title)
    none = lambda c: F.nullif(F.trim(c), F.lit(""))
    name = F.coalesce(none(F.regexp_extract(t, r"(?i)^(.*?),?\s+book\s+([0-9]+)", 1)), none(F.regexp_extract(t, r"^(.*?)\s*#([0-9]+)", 1)), none(F.regexp_extract(t, r"(?i)book\s+[0-9]+\s+of\s+(.*)$", 1)))
    index = F.coalesce(none(F.regexp_extract(t, r"(?i)book\s+([0-9]+)", 1)), none(F.regexp_extract(t, r"#([0-9]+)", 1))).try_cast("int")
    return F.struct(name.alias("name"), index.alias("index"))


def title_from_filename(path: Column | str) -> Column:
    """File name without folders and extension, marks as spaces (SRC4)."""
    base = F.regexp_replace(F.regexp_replace(_col(path), r"^.*/", ""), r"\.[^.]*$", "")
    return F.trim(F.regexp_replace(base, "[_-]+", " "))


#: British words with a spelling of their own, and the American one.
SPELLING_WORDS = {
    "grey": "gray", "greyer": "grayer", "greyest": "grayest", "greyish": "grayish", "tyre": "tire", "tyres": "tires", "mould": "mold",
    "moulds": "molds", "moulded": "molded", "moulding": "molding", "mouldy": "moldy", "plough": "plow", "ploughs": "plows", "ploughed": "plowed",
    "ploughing": "plowing", "kerb": "curb", "kerbs": "curbs", "programme": "program", "programmes": "programs", "cheque": "check",
    "cheques": "checks", "storey": "story", "storeys": "stories", "aluminium": "aluminum", "pyjamas": "pajamas", "sceptic": "skeptic",
    "sceptics": "skeptics", "sceptical": "skeptical", "scepticism": "skepticism", "moustache": "mustache", "moustaches": "mustaches",
    "moustached": "mustached", "draught": "draft", "draughts": "drafts", "draughty": "drafty", "cosy": "cozy", "cosier": "cozier",
    "cosiest": "coziest", "cosily": "cozily", "smoulder": "smolder", "smouldered": "smoldered", "smouldering": "smoldering", "woollen": "woolen",
    "woollens": "woolens", "gaol": "jail", "gaoler": "jailer", "practise": "practice", "practised": "practiced", "practises": "practices",
    "practising": "practicing", "encyclopaedia": "encyclopedia", "encyclopaedias": "encyclopedias", "foetus": "fetus", "foetuses": "fetuses",
    "foetal": "fetal", "paediatric": "pediatric", "paediatrics": "pediatrics", "paediatrician": "pediatrician", "anaemia": "anemia",
    "anaemic": "anemic", "oestrogen": "estrogen", "diarrhoea": "diarrhea", "coeliac": "celiac", "archaeology": "archeology",
    "archaeological": "archeological", "gynaecology": "gynecology", "haemorrhage": "hemorrhage", "haemoglobin": "hemoglobin",
    "leukaemia": "leukemia", "oesophagus": "esophagus", "orthopaedic": "orthopedic", "faeces": "feces", "anaesthesia": "anesthesia",
    "anaesthetic": "anesthetic", "amoeba": "ameba", "manoeuvre": "maneuver", "manoeuvres": "maneuvers", "manoeuvred": "maneuvered",
    "aesthetic": "esthetic", "aesthetics": "esthetics", "mediaeval": "medieval",
}
#: Words of the endings below that keep their spelling.
KEEP_WARDS = ("rewards", "awards", "cowards")
KEEP_OUR = ("flour", "scour", "velour", "detour", "contour", "devour", "pour", "sour", "tour", "dour")
KEEP_RE = ("genre", "genres", "acre", "acres", "ogre", "ogres", "massacre", "massacres", "mediocre", "lucre", "nacre", "macabre", "cadre", "cadres", "euchre", "timbre", "timbres", "oeuvre", "oeuvres")
#: Endings in the order in which they are tried, each a pattern of the whole word and what it becomes.
SPELLING_RULES = (
    (r"^(?!(?:" + "|".join(KEEP_WARDS) + r")$)(.+)wards$", "$1ward"),
    (r"^(.*)isation(s?)$", "$1ization$2"),
    (r"^(.+)is(ing|ers)$", "$1iz$2"),
    (r"^(.+)is(ed|es|er)$", "$1iz$2"),
    (r"^(..+)ise$", "$1ize"),
    (r"^(.*)ys(ing|ed|es|e)$", "$1yz$2"),
    (r"^(?!(?:" + "|".join(KEEP_OUR) + r")(?:s|ed|ing|er|ers|ite|ites|able|ables|ably|ful|fully|hood|less|ism|ous|y)?$)(..+)our(s?)$", "$1or$2"),
    (r"^(?!(?:" + "|".join(KEEP_OUR) + r")(?:ed|ing|er|ers|ite|ites|able|ables|ably|ful|fully|hood|less|ism|ous|y)$)(.+)our(ed|ing|er|ers|ite|ites|able|ables|ably|ful|fully|hood|less|ism|ous|y)$", "$1or$2"),
    (r"^(?!(?:" + "|".join(KEEP_RE) + r")$)(.+[^aeiou])re$", "$1er"),
    (r"^(.*)ogue(s?)$", "$1og$2"),
    (r"^(.+)ence(s?)$", "$1ense$2"),
    (r"^(.+)ll(ing|ed|ers|er)$", "$1l$2"),
    (r"^(.*)ll(ors|or|ous)$", "$1l$2"),
)


def canonical_spelling(word: Column | str) -> Column:
    """American spelling of a British word in lower case (SCA21): its own entry, else the first ending that fits."""
    w = _col(word)
    own = F.create_map(*[F.lit(x) for pair in SPELLING_WORDS.items() for x in pair])
    out = F.when(F.length(w) < 4, w).when(F.try_element_at(own, w).isNotNull(), F.try_element_at(own, w))
    for pattern, new in SPELLING_RULES:
        out = out.when(w.rlike(pattern), F.regexp_replace(w, pattern, new))
    return out.otherwise(w)


def plain_form(text: Column | str) -> Column:
    """Letters and digits in lower case, run together, each word spelled as it is (SCA3)."""
    return F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]", "")


def compare_form(text: Column | str) -> Column:
    """Letters and digits of the canonical tokens, run together (SCA22)."""
    return F.array_join(F.transform(tokenize(text), lambda w: F.regexp_replace(canonical_spelling(w), "'", "")), "")
