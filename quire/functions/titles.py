"""Column functions over titles, names of folders, and labels shown to readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as tx

#: Words of audio file names that do not tell works apart.
FILE_NOISE = ("64kb", "128kb", "librivox", "gutenberg")
#: Separators of author and title in the name of a folder, in the order in which they are tried.
SEPARATORS = (" – ", " — ", " - ")
#: Words that stay small within a title.
SMALL_WORDS = ("a", "an", "and", "as", "at", "but", "by", "for", "in", "of", "on", "or", "the", "to", "with")
#: Kind of heading by its first word.
HEADING_KINDS = (("ch", "Chapter"), ("chap", "Chapter"), ("chapter", "Chapter"), ("part", "Part"), ("book", "Book"))
#: Origins with the label and kind that readers see.
PROVENANCE = (
    ("author_recording", "Author recording", "human"), ("narrator_recording", "Narrator recording", "human"), ("librivox", "LibriVox (human)", "human"),
    ("tts_kokoro", "Kokoro TTS", "tts"), ("tts_preprocessed", "TTS source text", "tts"), ("whisper_transcript", "Transcript (speech-to-text)", "transcript"),
    ("publisher_epub", "Publisher EPUB", "publisher"), ("publisher_mobi", "Publisher MOBI", "publisher"), ("publisher_pdf", "Publisher PDF", "publisher"),
    ("user_upload", "Your import", "personal"), ("", "Your import", "personal"),
)
#: Most words of a spoken title, and the months that open a spoken date.
SPOKEN_WORDS = 6
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once however often it is used: a lambda's argument, where a column would be written out again."""
    return F.get(F.transform(F.array(value), use), 0)


def is_track_number(title: Column) -> Column:
    """Whether a title is a bare number of up to four digits (SCA11)."""
    return F.trim(title).rlike("^[0-9]{1,4}$")


def is_chapter_label(title: Column) -> Column:
    """Whether a title is a lone heading of a chapter or track (SCA11)."""
    return is_track_number(title) | F.trim(title).rlike(r"(?i)^(chapter|track|part|section|disc|disk|cd|side)\s*([0-9]+|[ivxlcdm]+)?$")


def clean_noisy_title(title: Column) -> Column:
    """A title without shop numbers and sound formats, nor the brackets that hold them (SCA12); other brackets stay."""
    bracket = r"[(\[][^)\]]*(\bB0[0-9A-Z]{8}\b|\b(?i:kbps?|stereo|mono|44100|22050|48000)\b)[^)\]]*[)\]]"
    bare = F.regexp_replace(F.regexp_replace(title, bracket, " "), r"\bB0[0-9A-Z]{8}\b", " ")
    return F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), "^[ \\-–—_]+|[ \\-–—_]+$", "")


def healed_title(title: Column) -> Column:
    """The cleaned title, unless nothing or a track number would be left (DQ10)."""
    clean = clean_noisy_title(title)
    return F.when((clean == "") | is_track_number(clean), title).otherwise(clean)


def _folder(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory_title(path: Column) -> Column:
    """Title of a folder named "Author - Title", else its name (SCA13)."""
    name, out = _folder(path), None
    for sep in SEPARATORS:
        found = F.instr(name, sep) > 0
        rest = F.trim(F.substr(name, F.instr(name, sep) + len(sep)))
        out = F.when(found, rest) if out is None else out.when(found, rest)
    return out.otherwise(F.trim(name))


def directory_author(path: Column) -> Column:
    """Author of a folder named "Author - Title", else empty (SCA13)."""
    name, out = _folder(path), None
    for sep in SEPARATORS:
        found = F.instr(name, sep) > 0
        head = F.trim(F.substring_index(name, sep, 1))
        out = F.when(found, head) if out is None else out.when(found, head)
    return out.otherwise("")


def authors_compatible(a: Column, b: Column) -> Column:
    """Whether two comparable authors may be one: equal, or one unknown (SCA8)."""
    return (a == b) | (a == "") | (b == "")


def match_key(title: Column, author: Column) -> Column:
    """Key of a file by its title without noise, after its author where that is known (SCA9)."""
    t = F.trim(F.regexp_replace(tx.normalize_title(title), "|".join(FILE_NOISE), ""))
    return F.when(author != "", F.concat_ws(" ", tx.normalize_title(author), t)).otherwise(t)


def title_number(words: Column) -> Column:
    """(n, used): number that a list of words starts with, in digits or in words up to ninety-nine, and how many words it takes (SCA14); n is null if none."""
    clean = lambda c: F.lower(F.regexp_replace(c, "[.,!?:;]+$", ""))
    value = lambda w: let(w, tx.number_word)

    def read(both: Column) -> Column:
        found = F.struct(value(both["a"]).alias("one"), F.when(~both["a"].contains("-"), value(F.concat(both["a"], F.lit(" "), both["b"]))).alias("two"))
        return let(found, lambda f: F.struct(F.nullif(F.coalesce(f["two"], f["one"]), F.lit(0)).alias("n"), F.when(f["two"].isNotNull(), 2).otherwise(1).alias("used")))

    return let(F.struct(clean(F.get(words, 0)).alias("a"), clean(F.get(words, 1)).alias("b")), read)


def _cut_title(t: Column) -> Column:
    at = lambda s: F.struct(F.substr(t, F.lit(1), F.instr(t, s) - 1).alias("head"), F.trim(F.substr(t, F.instr(t, s) + len(s))).alias("rest"))
    return F.coalesce(*[F.when(F.instr(t, s) > 1, at(s)) for s in (": ", " - ", " — ")], F.struct(t.alias("head"), F.lit("").alias("rest")))


def chapter_title(title: Column) -> Column:
    """One form for headings (SCA15): "Ch. Twenty-two - Words." becomes "Chapter 22: Words"; other titles are left as they are."""
    kinds = F.create_map(*[F.lit(x) for pair in HEADING_KINDS for x in pair])
    trimmed = lambda c: F.regexp_replace(c, "[.,!?:; ]+$", "")
    after = lambda words, n: F.slice(words, n + 1, F.greatest(F.size(words) - n, F.lit(0)))

    def parsed(cut: Column) -> Column:
        own = lambda w: F.struct(cut["rest"].alias("rest"), w.alias("words"), F.try_element_at(kinds, F.lower(F.regexp_replace(F.get(w, 0), "[.,!?:;]+$", ""))).alias("kind"), let(after(w, F.lit(1)), title_number).alias("number"))
        return let(tx.fields(cut["head"]), own)

    def written(p: Column) -> Column:
        left = trimmed(F.array_join(after(p["words"], p["number"]["used"] + 1), " "))
        rest = trimmed(F.array_join(F.array_remove(F.array(left, p["rest"]), ""), " "))
        made = let(rest, lambda r: F.concat(p["kind"], F.lit(" "), p["number"]["n"].cast("string"), F.when(r != "", F.concat(F.lit(": "), r)).otherwise("")))
        return F.when(p["kind"].isNotNull() & p["number"]["n"].isNotNull(), made)

    return F.coalesce(let(let(let(F.trim(title), _cut_title), parsed), written), title)


def title_case(title: Column) -> Column:
    """A title mostly in capitals, or in one case, with capital initials (SCA20); small words within it stay small."""
    t = F.trim(title)
    upper, lower = F.length(F.regexp_replace(t, "[^A-Z]", "")), F.length(F.regexp_replace(t, "[^a-z]", ""))
    words = tx.fields(t)
    last = F.size(words) - 1
    cased = F.transform(words, lambda w, i: F.when((i > 0) & (i < last) & F.lower(w).isin(*SMALL_WORDS), F.lower(w)).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))))
    return F.when((upper > 0) & (lower > 0) & (upper * 10 < (upper + lower) * 7), t).otherwise(F.array_join(cased, " "))


def spoken_title(content: Column) -> Column:
    """Title that follows a spoken "Chapter 5." at the start of a text (SCA18), empty where it would be a guess.

    It ends at the end of a sentence or at a spoken date, has at most six words,
    no digit, and starts with a capital.
    """
    announced = r"(?i)^\s*(?:chapter|part|book|section)\s+(?:[0-9]+|[a-z]+(?:[- ](?:one|two|three|four|five|six|seven|eight|nine))?)\s*[.:,]\s*"
    rest = F.when(content.rlike(announced), F.regexp_replace(content, announced, ""))
    sentence = F.regexp_extract(rest, r"^([^.!?]*)[.!?](?:\s|$)", 1)
    candidate = F.trim(F.when(rest.rlike(r"^[^.!?]*[.!?](?:\s|$)"), sentence).otherwise(rest))
    dated = rf"(?i)^(.*?)\s*(?:\b(?:{MONTHS})\b[.,;:!?\-—]*\s+[0-9].*|(?<=^|\s)[.,;:!?\-—]*[0-9].*)$"
    undated = F.trim(F.when(candidate.rlike(dated), F.regexp_extract(candidate, dated, 1)).otherwise(candidate))
    words = F.size(tx.fields(undated))
    fine = (words >= 1) & (words <= SPOKEN_WORDS) & ~undated.rlike("[0-9]") & undated.rlike(r"^\p{Lu}") & ~candidate.rlike(r"(?i)^(chapter|part|book|section)\s+([0-9]+|one|two|three|four|five|six|seven|eight|nine|ten)\b")
    return F.coalesce(F.when(fine, undated), F.lit(""))


def provenance(origin: Column) -> Column:
    """(label, kind) of an origin (SCA44); unknown ones by their own name."""
    pick = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for p in PROVENANCE for x in (p[0], p[i])]), origin)
    return F.struct(F.coalesce(pick(1), F.initcap(F.replace(origin, F.lit("_"), F.lit(" ")))).alias("label"), F.coalesce(pick(2), F.lit("personal")).alias("kind"))


def remaining_time(elapsed: Column, done: Column, total: Column) -> Column:
    """What is left of a job at its mean pace, in words (SCA46); unknown in the first two seconds and before the first item."""
    left = F.try_divide(elapsed, done) * (total - done)
    whole = lambda x: F.floor(x).cast("string")
    shown = F.when(left < 60, F.concat(F.lit("~"), whole(left), F.lit("s remaining"))).when(left < 3600, F.concat(F.lit("~"), whole(left / 60), F.lit("m remaining")))
    shown = shown.otherwise(F.concat(F.lit("~"), whole(left / 3600), F.lit("h "), whole(F.floor(left / 60) % 60), F.lit("m remaining")))
    return F.when((done == 0) | (elapsed < 2), "estimating...").otherwise(shown)


def trust_line(state: Column, doubtful: Column, total: Column) -> Column:
    """What a trust state says with its numbers (OTH22)."""
    n, of = F.format_number(doubtful, 0), F.format_number(total, 0)
    share = lambda d: F.format_number(100.0 * doubtful / total, d)
    return (
        F.when(state == "unchecked", "Not checked against the audio")
        .when(state == "verified", F.concat(F.lit("All "), of, F.lit(" words match")))
        .when(state == "significant", F.concat(n, F.lit(" of "), of, F.lit(" words ("), share(1), F.lit("%) may not match")))
        .otherwise(F.concat(n, F.lit(" of "), of, F.lit(" words ("), share(2), F.lit("%) in doubt")))
    )
