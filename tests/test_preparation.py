"""Announcements, blocks in markup and texts to be spoken, against rules written out step by step."""

import random
import re

from pyspark.sql import functions as F

from quire.operators import announce, markup, speech

TENS, UNITS = "twenty thirty forty fifty sixty seventy eighty ninety".split(), "zero one two three four five six seven eight nine ten eleven twelve thirteen".split()


def number_length(tokens):
    bare = [t.rstrip(".,!?:;").lower() for t in tokens]
    if re.fullmatch(r"\d{1,3}", bare[0]) and int(bare[0]):
        return 1
    if bare[0] in TENS:
        return 2 if len(bare) > 1 and bare[1] in UNITS[1:10] else 1
    a, _, b = bare[0].partition("-")
    return 1 if bare[0] in UNITS[1:] or (a in TENS and b in UNITS[1:10]) else 0


def announced(words, silences):
    """By every prefix in turn: the shortest that ends a sentence or stands before a pause."""
    w = words[:20]
    if len(w) < 2:
        return 0
    first = w[0][0].strip().rstrip(".,!?:;").lower()
    if first in announce.NAMED:
        return 1
    body = 2 if first in announce.NUMBERED else number_length([x[0].strip() for x in w[:2]])
    if not body:
        return 0
    for size in range(body + 1, len(w) + 1):
        last = w[size - 1]
        if last[0].strip()[-1:] in tuple(".!?"):
            return size
        if size < len(w):
            quiet = [b - a for a, b in silences if last[2] - 0.15 < a < w[size][2]]
            if max([w[size][1] - last[2], *quiet]) >= 0.6:
                return size
    return body


def test_announcements_equal_all_prefixes(spark):
    r = random.Random(2)
    words, silences, starts, want = [], [], [], {}
    vocabulary = ["Chapter", "part", "Book", "Prologue.", "twenty", "three", "Twenty-one,", "7.", "12", "000", "the", "end.", "Why?", "zero", " hers", "sixty"]
    for book in range(60):
        t, own, quiet = 0.0, [], []
        for pos in range(r.randint(0, 60)):
            length = r.choice([0.2, 0.3])
            own.append((r.choice(vocabulary), round(t, 2), round(t + length, 2)))
            t += length + r.choice([0.05, 0.05, 0.05, 0.3, 0.8])
            if r.random() < 0.1:
                quiet.append((round(t - 0.07, 2), round(t - 0.07 + r.choice([0.2, 0.7]), 2)))
        words += [(book, i, *x) for i, x in enumerate(own)]
        silences += [(book, *q) for q in quiet]
        for start in {0, r.randint(0, 50), 19, 40}:
            if start < len(own):
                starts.append((book, start))
                want[book, start] = announced(own[start:], quiet)
    frame = lambda data, kind: spark.createDataFrame(data, kind)
    got = announce.announcements(frame(starts + starts[:3], "book int, start int"), frame(words, "book int, pos int, w string, s double, e double"), frame(silences, "book int, a double, b double"), ["book"])
    assert {(x["book"], x["start"]): x["length"] for x in got.collect()} == want
    assert len(set(want.values())) > 6


def test_blocks_go_and_every_other_byte_stays(spark):
    page = '<BODY>\r\n<p>Keep  me</p>\n<div class="x">The “Head”\n <b>Line</b></div><h2>Title</h2>\ttail <p>open <p>The "Head" Line</p>é<div></div>'
    pages = [(1, i, page.replace("Title", f"Title {i}")) for i in range(5)] + [(2, 9, page), (2, 10, ""), (3, 11, None)]
    df = spark.createDataFrame(pages, "work int, page int, html string")
    heads = markup.header_blocks(df, "work", "page", "html")
    assert {(x["work"], x["line"]) for x in heads.collect()} == {(1, "Keep me"), (1, 'The "Head" Line'), (1, 'open The "Head" Line')}
    only = heads.where("line = 'The \"Head\" Line'")
    got = {x["page"]: x["html"] for x in markup.without_header_blocks(df, only, "work", "html").collect()}
    cut = page.replace('<div class="x">The “Head”\n <b>Line</b></div>', "")
    assert got == {**{i: cut.replace("Title", f"Title {i}") for i in range(5)}, 9: page, 10: "", 11: None}
    spans = markup.block_spans(df.where("page = 9"), ["page"], "html").orderBy("n").collect()
    assert [page[x["start"] : x["stop"]] for x in spans] == ["<p>Keep  me</p>", '<div class="x">The “Head”\n <b>Line</b></div>', "<h2>Title</h2>", '<p>open <p>The "Head" Line</p>', "<div></div>"]


def test_pages_are_cut_before_chapter_headings(spark):
    pages = {
        1: "lead<h1>Book</h1>x<h2 id='a'>Chapter <i>One</i></h2>\r\n<p>a</p><h4>Notes</h4>b<H3>iv.</H3>c", 2: "<h1>Chapter 1</h1>only one", 3: "<h2>Act 1</h2>a<h2>Scene 2</h2>", 4: "", 5: "no heading at all",
        6: "<h1>The Book of Kings</h1>intro<h2>12</h2>a<h2>13.</h2>b", 7: "<h2>Mildred</h2>x<h3>Mill</h3>y<h3>Bookish</h3>",
    }
    df = spark.createDataFrame(list(pages.items()), "page int, html string")
    got = {x["page"]: [(c["title"], c["html"]) for c in x["c"]] for x in df.select("page", markup.chapters_of_page(F.col("html")).alias("c")).collect()}
    assert all("".join(h for _, h in got[i]) == html for i, html in pages.items())
    assert [t for t, _ in got[1]] == ["", "Book", "Chapter One", "iv."] and [t for t, _ in got[3]] == ["Act 1", "Scene 2"]
    assert got[2] == [("Chapter 1", pages[2])] and got[4] == [("", "")] and got[5] == [("", pages[5])]
    assert [t for t, _ in got[6]] == ["The Book of Kings", "12", "13."] and len(got[7]) == 1


def regions_by_steps(lines):
    out, skip = [], False
    for x in lines:
        skip = skip or any(m in x.strip() for m in speech.REGION_OPENS)
        if skip:
            skip = bool(x.strip())
            continue
        out.append(x)
    return out


def apparatus_by_steps(lines):
    out, listing, take = [], False, False
    for x in lines:
        t = x.strip()
        if take:
            take = False
        elif re.search(speech.EDITIONS, t):
            listing = True
        elif listing and re.search(speech.EDITION_LINE, t):
            pass
        else:
            listing = False
            if re.search(speech.EDITORS_NOTE, t):
                take = t.endswith(":")
            else:
                out.append(x)
    return out


def cased(s):
    return re.sub(r"(?a)\b\w", lambda m: m[0].upper(), s.lower())


def capitals(s):
    return any(c.isalpha() for c in s) and not any(c.islower() for c in s)


def opening(s):
    return [w for w in re.split("[^a-z0-9]+", s.lower()) if w][:24]


def spoken_by_steps(title, text):
    lines, said, paused, title = regions_by_steps(text.split("\n")), "", False, title.strip()
    t = opening(title)
    if title and not any(m in title.lower() for m in speech.SKIPPED_TITLES) and not (t and opening("\n".join(lines))[: len(t)] == t):
        said = (cased(title) if capitals(title) else title) + ".\n\n"
    for x in map(str.strip, lines):
        if not x:
            paused = True
        elif x.lower() == title.lower() or any(m in x.lower() for m in speech.SKIPPED_LINES):
            pass
        elif capitals(x) and len(x.encode()) < 80:
            said += ("\n\n" if said and not paused else "") + cased(x) + ("" if x[-1] in ".!?" else ".") + "\n\n"
            paused = True
        else:
            said += ("\n\n" if paused else " ") + x if said else x
            paused = False
    return said.strip()


def texts(seed, n=150):
    r = random.Random(seed)
    kinds = ["", "", "Some words here", "more of it.", "A HEADING", "ÉTÉ À PARIS!", "don't stop", "Produced by hand", "*** START OF THE PROJECT GUTENBERG EBOOK X ***", "see www.gutenberg.org", "the title", "  padded  ", "x" * 90, "LOUD " * 20, "Contents", "123 - 456"]
    titles = ["", "The Title", "THE TITLE", "Contents", "Some words", "Ça va, don't", "---", "  a  "]
    return [(i, r.choice(titles), "\n".join(r.choices(kinds, k=r.randint(0, 14)))) for i in range(n)]


def test_speech_equals_the_rules_step_by_step(spark):
    data = texts(5)
    got = speech.prepared(spark.createDataFrame([*data, (900, None, None), (901, "T", None)], "i int, title string, text string").repartition(3), ["i"], "title", "text")
    found = {x["i"]: x["speech"] for x in got.collect()}
    assert found == {i: spoken_by_steps(t, x) for i, t, x in data} | {900: "", 901: "T."}


def test_apparatus_and_regions_equal_the_rules_step_by_step(spark):
    r = random.Random(6)
    kinds = ["", "prose line", "There are several editions of this ebook in the Project Gutenberg collection.", "Click on any of the filenumbers below", "1234 (plain text)", "12 (two) men", "Project Gutenberg Editor's Note:", "project gutenbergs editors note: inline", "Produced by hand", " "]
    data = [(i, [r.choice(kinds) for _ in range(r.randint(1, 12))]) for i in range(200)]
    df = spark.createDataFrame(data, "i int, l array<string>").select("i", F.posexplode("l").alias("line_idx", "line"))
    grouped = lambda d: {x["i"]: [v["line"] for v in sorted(x["rows"], key=lambda v: v["line_idx"])] for x in d.groupBy("i").agg(F.collect_list(F.struct("line_idx", "line")).alias("rows")).collect()}
    assert grouped(speech.without_apparatus(df, ["i"])) == {i: out for i, lines in data if (out := apparatus_by_steps(lines))}
    assert grouped(speech.without_skipped_regions(df, ["i"])) == {i: out for i, lines in data if (out := regions_by_steps(lines))}
