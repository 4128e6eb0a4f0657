"""Exact round trips of media columns, and pages whose main text is known."""

from __future__ import annotations

import hashlib
import time
import zlib
from fractions import Fraction

import pytest

from trackloom.llm import html_text, media

TEXTS = [None, "", "short", "é" * 300, "x" * 576, "y" * 577, "long text " * 40_000, "short"]


def test_texts_come_back_from_audio(spark):
    rows = [(i, t, 5, "n") for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in media.report(spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, media string")).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        want = raw + b"\xff" * ((-len(raw) % 576) if raw else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert f"frames={len(want) // 576};" in r.feature and "bad=0;skipped=0" in r.feature
    assert tuple(got[2])[1:] == tuple(got[7])[1:] and tuple(got[0])[1:] == tuple(got[1])[1:]
    assert media.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_damaged_streams_are_found_again():
    payload = bytes(range(256)) * 9
    data = media.encode(media.padded(payload))
    whole = media.decode(data)
    assert whole["tags"] == ["ID3v2", "ID3v1"] and whole["table"]["kind"] == "Info" and whole["table"]["frames"] == 4
    assert whole["duration"] == Fraction(4 * 1152, 48000) and whole["checked"] == 4 and whole["bad"] == 0
    third = whole["offsets"][2]
    flipped = bytearray(data)
    flipped[third + 8] ^= 1
    assert media.decode(bytes(flipped))["bad"] == 1
    torn = data[: third + 100] + b"\xff\xfbnoise\xff" + data[third + 300 :]
    found = media.decode(torn)
    assert found["skipped"] > 0 and found["offsets"][-1] == whole["offsets"][3] - 200 + 8
    for junk in (b"", b"\xff" * 1000, b"ID3", b"TAG" + b"\0" * 125, b"no audio here"):
        assert media.decode(junk)["offsets"] == [] and media.decode(junk)["duration"] == 0


def vbr_frames(n):
    """Unprotected MPEG-1 Layer III frames of 128 kbit/s at 44.1 kHz, mono: 417 bytes each."""
    return [bytearray(b"\xff\xfb\x90\xc0" + bytes(413)) for _ in range(n)]


def test_variable_bitrate_tables():
    frames = vbr_frames(4)
    frames[0][21:37] = b"Xing" + (3).to_bytes(4, "big") + (3).to_bytes(4, "big") + (1251).to_bytes(4, "big")
    read = media.decode(b"".join(frames))
    assert read["table"] == {"kind": "Xing", "frames": 3, "bytes": 1251, "toc": b""} and len(read["offsets"]) == 3 and read["offsets"][0] == 417
    assert read["duration"] == Fraction(3 * 1152, 44100) and read["checked"] == 0
    frames = vbr_frames(3)
    frames[0][36:54] = b"VBRI" + bytes(6) + (834).to_bytes(4, "big") + (2).to_bytes(4, "big")
    read = media.decode(b"".join(frames))
    assert (read["table"]["kind"], read["table"]["frames"], read["table"]["bytes"]) == ("VBRI", 2, 834) and len(read["offsets"]) == 2
    assert media.decode(b"".join(vbr_frames(3)))["table"] is None


def bitwise_crc(bits):
    out = 0xFFFF
    for b in bits:
        out = ((out << 1) & 0xFFFF) ^ (0x8005 if (out >> 15) != b else 0)
    return out


@pytest.mark.parametrize(
    ("head", "widths", "bound"),
    [
        (b"\xff\xfe\x40\xc0", [4] * 32, 32),  # Layer I, mono
        (b"\xff\xfe\xc0\x50", [4] * 32, 8),  # Layer I, joint stereo from band 8 on
        (b"\xff\xfc\x80\xc0", [4] * 11 + [3] * 12 + [2] * 7, 32),  # Layer II, 128 kbit/s mono at 44.1 kHz
        (b"\xff\xfc\x24\xc0", [4] * 2 + [3] * 6, 32),  # Layer II, 48 kbit/s mono at 48 kHz
        (b"\xff\xfc\xa0\x40", [4] * 11 + [3] * 12 + [2] * 7, 4),  # Layer II, 192 kbit/s joint stereo at 44.1 kHz
        (b"\xff\xf4\x80\xc0", [4] * 4 + [3] * 7 + [2] * 19, 32),  # MPEG-2 Layer II, mono
    ],
)
def test_checksums_of_the_other_layers(head, widths, bound):
    found = media.header(head + bytes(4000), 0)
    layer, channels = found[1], 1 if head[3] >> 6 == 3 else 2
    frame = bytearray(head + bytes(2) + bytes((37 * i * i + 11) % 256 for i in range(found[2] - 6)))
    bits = [(byte >> k) & 1 for byte in frame[6:] for k in range(7, -1, -1)]
    n = chosen = 0
    for band, width in enumerate(widths):
        for _ in range(channels if band < bound else 1):
            chosen += any(bits[n : n + width]) * (1 if band < bound else channels)
            n += width
    n += 2 * chosen if layer == 2 else 0
    crc = bitwise_crc([(byte >> k) & 1 for byte in head[2:] for k in range(7, -1, -1)] + bits[:n])
    frame[4:6] = crc.to_bytes(2, "big")
    whole = media.decode(bytes(frame) * 3)
    assert (whole["checked"], whole["bad"], len(whole["offsets"])) == (3, 0, 3)
    frame[6] ^= 0x10
    assert media.decode(bytes(frame) * 3)["bad"] == 3


def test_streams_of_any_bytes(spark):
    rows = spark.createDataFrame([(1, bytearray(media.encode(media.padded(b"abc")))), (2, None), (3, bytearray(b"zz"))], "id long, media binary")
    got = {r.id: r.mpeg for r in media.streams(rows).collect()}
    assert got[1].n_frames == 1 and got[1].seconds == pytest.approx(0.024) and got[2].n_frames == got[3].n_frames == 0


PAGES = [
    (None, ""),
    ("", ""),
    ("<p>", ""),
    (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>Home</a></li><li><a>More</a></li></ul></nav><div class='ad'>Buy now and save</div>"
        "<article><h1>Head &amp; line</h1><p><b>First</b> words\n of&nbsp;the text.<br>Next.<p>Second block.</p><p>Caf&eacute; &#8211; ok.</p><form>Mail <input></form></article>"
        "<section id='comments'><p>A reader writes a long comment about all of this and more.</p></section><aside>Also read</aside><footer>&copy; all</footer></body></html>",
        "Head & line\n\nFirst words of the text. Next.\n\nSecond block.\n\nCafé – ok.",
    ),
    ("<body><div class=menu><a>a</a> <a>b</a></div><div id=content><p>" + "Plain text without any region. " * 5 + "</p><p>" + "And a second part of it. " * 5 + "</p></div></body>", ("Plain text without any region. " * 5).strip() + "\n\n" + ("And a second part of it. " * 5).strip()),
]

LONG = "A long enough sentence of the article, with words and a full stop. " * 3
INSIDE = [
    ("<section id='discussion'><p>We discuss.</p></section>", "We discuss."),
    ("<div class='share-price'>Shares at 12.40</div>", "Shares at 12.40"),
    ("<p class='alert-level'>Level two</p>", "Level two"),
    ("<p class='search-results-note'>A note.</p>", "A note."),
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p>", "Let x=2 be."),
    ("<header><h2>Part</h2></header>", "Part"),
    ("<ul><li><a href=1>Source one</a></li></ul>", "Source one"),
    ("<div class='related'><p>Related work is old.</p></div>", "Related work is old."),
    ("<div class='related'><p><a href=1>Also read this one</a></p></div>", ""),
    ("<div class='ad-slot'>Buy</div>", ""),
    ("<ol class='commentlist'><li>Nice one</li></ol>", ""),
    ("<article class='comment'><p>Nice one</p></article>", ""),
    ("<div role='navigation'>Up</div>", ""),
    ("<nav>Up</nav><footer>By me</footer><form>Mail <input></form>", ""),
]


def test_parts_of_an_article():
    for form in ("<article class='post comments-open'>{}</article>", "<main class='no-sidebar'>{}</main>", "<div class='layout has-sidebar'><article>{}</article></div>"):
        for part, want in INSIDE:
            if "class='related'" in part and "<main" in form:
                continue  # a name outside of articles
            html = "<body>" + form.format(f"<p>{LONG}</p>{part}<p>Short.</p>") + "<div class='site-footer'>Imprint</div></body>"
            assert html_text.main_text(html) == "\n\n".join(x for x in (LONG.strip(), want, "Short.") if x), (form, part)


def test_clusters_select_regions():
    teasers = "".join(f"<article><a href={i}>Teaser number {i} of this list</a></article>" for i in range(4))
    page = f"<main>{{}}<p>{LONG}</p><p>Short.</p>{teasers}</main>"
    assert html_text.main_text(page.format("")).startswith(LONG.strip())
    one = f"<div>{'<div>Tiny line</div>' * 6}</div><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div>Imprint</div>"
    assert html_text.main_text(one) == f"{LONG.strip()}\n\nShort.\n\n{LONG.strip()}"


def test_smoothing_takes_part():
    page = f"<body><p>Intro of few words.</p><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>" + "<div><a href=1>x</a></div>" * 8 + "</body>"
    lines = html_text.parsed(page).lines
    smooth, raw = html_text.content_lines(lines)[0], html_text.content_lines(lines, 0)[0]
    assert smooth[2] and not raw[2]
    # a dense line within reach of the article's cluster comes with it only where the ratios are smoothed
    far = f"<body><p>{LONG}</p><p>By A</p><div><p>{LONG * 4}</p></div>" + "<div><a href=1>x</a></div>" * 8 + "</body>"
    assert html_text.main_text(far) == f"{LONG.strip()}\n\n{(LONG * 4).strip()}" != html_text.main_text(far, 0)


def test_broken_markup_takes_no_more_than_linear_time():
    began = time.time()
    n = 100_000
    for html in ("<b>x" * n, "<b>" * n + "</i>" * n, "<div>x" * n, "<ul><li>x" * n, "<head>" * n, "<!--" * n, "</" * n, "<a " * n, "<script>" + "</" * n):
        html_text.main_text(html)
    assert time.time() - began < 60
    assert html_text.main_text("<article>Text &amp") == "Text &" and html_text.main_text("<article>Text<a hr") == "Text"


def test_main_text_of_pages(spark):
    rows = [(i, f"u{i}", h, 1) for i, (h, _) in enumerate(PAGES)] * 2
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == PAGES[r.page_id][1] and r.n_chars == len(r.text), r.page_id
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_broken_and_very_long_markup():
    assert html_text.main_text("<article>" + "<div>" * 3000 + "deep" + "</p>" * 3000) == "deep"
    long = "<article><p>" + "word " * 200_000 + "</p><p>end</p></article>"
    assert html_text.main_text(long).endswith("\n\nend")


STORY = [f"Sentence {i} of the story has some words to read, and then a few more of them." for i in range(8)]
APART = [
    'div class="cookie-notice"', "div class=notice", 'div class="alert alert-info"', "section class=gdpr-consent", 'ul class="comment-list"', "section class=comment-section", "div class=reader-comments", "div id=user-comments",
    "div id=responses", "div class=related-posts", "div class=newsletter-signup", "div class=ad-banner", 'p class="banner-ad"', "div class=sponsored-content", "div class=promo-box", "div class=subscribe-box", "ul class=menu", "div role=note",
]


@pytest.mark.parametrize("start", APART)
def test_named_parts_inside_articles_go(start):
    tag = start.split()[0]
    text = "Plain text of a part that is no part of the article, as long as one of its paragraphs, without any link."
    inner = f"<li>{text}</li>" if tag == "ul" else text if tag == "p" else f"<p>{text}</p><p>{text}</p>"
    html = "<body><article><h1>Title</h1>" + "".join(f"<p>{x}</p>" for x in STORY[:4]) + f"<{start}>{inner}</{tag}>" + "".join(f"<p>{x}</p>" for x in STORY[4:]) + "</article></body>"
    assert html_text.main_text(html) == "\n\n".join(["Title", *STORY])


@pytest.mark.parametrize("name", ["has-sidebar", "post comments-open", "no-cookies-here", "shared-value", "adaptive layout"])
def test_names_in_doubt_stay_where_there_is_content(name):
    html = f"<body><article><h1>Title</h1><div class='{name}'>" + "".join(f"<p>{x}</p>" for x in STORY) + "</div></article></body>"
    assert html_text.main_text(html) == "\n\n".join(["Title", *STORY])


def test_text_of_main_beside_an_article():
    html = f"<body><nav><a href=/>Home</a></nav><main><h1>Title</h1><p>{STORY[0]}</p><article><p>" + "</p><p>".join(STORY[1:7]) + f"</p></article><p>{STORY[7]}</p><div><a href=/x>Next</a></div></main></body>"
    assert html_text.main_text(html) == "\n\n".join(["Title", *STORY])


def test_the_mass_of_clusters_chooses_the_region():
    teaser = "<article><p>Short.</p></article>"
    html = f"<body>{teaser}<div><div>" + "".join(f"<p>{x}</p>" for x in STORY) + "</div></div></body>"
    assert html_text.main_text(html) == "\n\n".join(STORY)


def mixed(n):
    """Pages of many layouts, each with loose text of links, counters and captions in and around its article."""
    out = []
    for k in range(n):
        body = []
        for i, x in enumerate(STORY[: 3 + k % 5]):
            body.append(f"<p>{x * (1 + (i + k) % 3)}</p>")
            if (i + k) % 2:
                body.append(f"<div><span>{'Look ' * (k % 4 + 1)}</span><i></i><i></i></div><div><b>{k}</b><i></i></div><div><u>up</u></div>" * (1 + k % 3))
        outer = ("article", "main", "div")[k % 3]
        out.append(f"<body><div><a href=/>x</a></div><{outer}>{''.join(body)}</{outer}><div>{k} <a href=/>y</a></div></body>")
    return out


def test_smoothing_decides_in_mixed_layouts():
    pages = mixed(30)
    plain, smooth = [html_text.main_text(p, 0) for p in pages], [html_text.main_text(p) for p in pages]
    assert sum(a != b for a, b in zip(plain, smooth, strict=True)) >= 5
    for k, text in enumerate(smooth):
        assert all(x * (1 + (i + k) % 3) in text for i, x in enumerate(STORY[: 3 + k % 5]))


def test_streams_keep_a_column_of_their_name(spark):
    rows = spark.createDataFrame([(1, "own", None), (1, "own", None)], "id long, mpeg string, media binary")
    made = media.streams(rows)
    assert made.columns == ["id", "mpeg", "media", "mpeg_"] and [(r.mpeg, r.mpeg_.n_frames) for r in made.collect()] == [("own", 0)] * 2
    assert media.streams(rows.limit(0)).count() == 0 and media.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
