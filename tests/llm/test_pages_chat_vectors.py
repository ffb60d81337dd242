"""Operators on pages, conversations and vectors."""

import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import chat, pages, topk, vectors

# --- pages


def page(i, title, paragraphs, extra="", body_class="has-sidebar"):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        f'<html><head><title>{title} | Site</title><style>p {{}}</style><script>var a = "</p><article>";</script></head><body class="{body_class}">'
        f'<header><a href="/">Site</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav><div class="cookie-notice">We use cookies</div>'
        f'<div class="wrap"><div class="post-body" id="post-{i}"><h1>{title}</h1>{body}<p>Subscribe now for more.</p>{extra}</div>'
        f'<aside>See also</aside><section class="comments"><p>reader {i} says hi</p></section></div><form><button>Go</button></form><footer>&copy; Site</footer></body></html>'
    )


def site(n, extra=""):
    rng = random.Random(9)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(15, 40)))
    return [(i, f"Title {i} {rng.choice(words)}", [text() for _ in range(rng.randrange(2, 5))]) for i in range(n)]


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_template_of_a_host_without_article_elements(spark):
    made = site(12)
    rows = [(i, f"https://a.example.com/p/{i}", page(i, t, ps)) for i, t, ps in made]
    found = {r.page_id: r for r in pages.extract(pages_of(spark, rows)).collect()}
    for i, t, ps in made:  # the sentence of every page is part of the template
        assert found[i].text == "\n".join([t, *ps]) and found[i].n_chars == len(found[i].text) and found[i].n_classes >= 1


def test_copies_on_a_host_are_content(spark):
    rows = [(i, "https://b.example.com/x", page(1, "Same", ["one two three four five six seven", f"tail {i}"])) for i in range(12)]
    rows += [(100 + i, "https://c.example.com/x", page(1, "Same", ["one two three"])) for i in range(12)]
    found = {r.page_id: r.text for r in pages.extract(pages_of(spark, rows)).collect()}
    assert found[3] == "Same\none two three four five six seven\ntail 3\nSubscribe now for more."
    assert found[103].startswith("Same\none two three")


def test_odd_pages(spark):
    rows = [
        (1, None, None), (2, "not an address", ""), (3, "http://x.org/", "<article>a &amp; b&nbsp; c<br>d<div>e</div></article>"), (3, "http://x.org/", "plain text only"),
        (4, "http://x.org/2", "<article><p>open <b>bold<br><p>next</article><p>after"), (5, "http://x.org/3", "<p>cut off <a hre"),
        (6, "http://x.org/4", '<main><h2>t</h2><p title="a > b">x</p><ul><li>1<li>2</ul><table><tr><td>c<td>d</table></main>'), (7, "http://x.org/5", "<!-- never closed <p>x</p>"),
        (8, "http://x.org/6", "<p>1 < 2 and 3 > 2</p>" + "<div>" * 3000 + "deep" + "</div>" * 3000), (9, "http://x.org/7", "<article>" + "<p>word word</p>" * 20_000 + "</article>"),
    ]
    clash = pages_of(spark, rows).selectExpr("page_id", "url", "html", "'mine' AS text", "1 AS host")
    found = [(r.page_id, r.text) for r in pages.extract(clash).collect()]
    texts = dict(found)
    assert len(found) == len(rows) and sorted(t for i, t in found if i == 3) == ["a & b c d\ne", "plain text only"]
    assert texts[1] == texts[2] == texts[7] == "" and texts[4] == "open bold\nnext" and texts[5] == "cut off"
    assert texts[6] == "t\nx\n1\n2\nc\nd" and texts[8] == "1 < 2 and 3 > 2\ndeep" and texts[9].count("\n") == 19_999
    assert pages.extract(pages_of(spark, [])).count() == 0


def test_words_of_classes_do_not_decide_over_the_main_text(spark):
    rows, wanted = [], {}
    for i, title, paragraphs in site(10):
        inner = f"<h2 id='how-to-search'>{title}</h2><section id='online-advertising'><p>{paragraphs[0]}</p></section><p>{paragraphs[1]}</p><p class='notice'>{paragraphs[1]} {paragraphs[0]}</p>"
        for at, html in enumerate((
            f"<body><div class='right-sidebar'><article>{inner}</article></div><div class='ad'>buy {i}</div></body>",
            f"<body><div class='with-sidebar page-sidebar'><div class='text'>{inner}</div><div class='sidebar'>other {i}</div></div></body>",
        )):
            for host in (f"{at}.example.com", f"{at}-{i}.example.com"):  # with a template, and alone on its host
                rows.append((len(rows), f"https://{host}/", html))
                wanted[len(rows) - 1] = "\n".join([title, *paragraphs[:2], f"{paragraphs[1]} {paragraphs[0]}"]) if at == 0 or "-" not in host else None
    found = {r.page_id: r.text for r in pages.extract(pages_of(spark, rows)).collect()}
    for i, text in wanted.items():
        if text is not None:
            assert found[i] == text
        else:  # no article and no template: the wrapper stays for what it holds, small elements named so go
            assert found[i] and "other" not in found[i]


def tokens_of(sources):
    """Tokens of a host with explicit occurrence vectors, the plain version of what Spark sums up."""
    rows, distinct = {}, sorted(set(sources))
    for n, source in enumerate(sources):
        page = pages.Page(source)
        seen = page.totals()
        for node, text, _, dropped in page.blocks:
            if not dropped:
                path = page.nodes[node][0]
                now = seen.setdefault(pages._text_token(path, text), [path, None, 0, 0, 0, 0, 0])
                now[2] += 1
                now[3] += len(text)
        for token, (parent, key, count, *numbers) in seen.items():
            r = rows.setdefault(token, {"token": token, "parent": parent, "key": key, "on": {}, "pages": 0, "total": 0, "chars": 0, "links": 0, "before": 0, "after": 0})
            r["on"][n] = (source, count)
            r["pages"] += 1
            r["total"] += count
            for name, number in zip(("chars", "links", "before", "after"), numbers, strict=True):
                r[name] += number
    vectors_of = {}
    for r in rows.values():
        r["low"], r["high"] = vectors_of.setdefault(tuple(sorted(r.pop("on").items())), len(vectors_of)), 0
    return list(rows.values()), len(distinct)


def test_classes_nest_and_find_the_slot():
    tokens, distinct = tokens_of([page(n, f"t{n}", [f"x{n} " * 30, f"y{n} " * 20]) for n in range(20)])
    found = pages.deduce(tokens, distinct)
    assert found["n_classes"] >= 2 and next(t["key"] for t in tokens if t["token"] == found["main"]).startswith("div.post-body")
    fixed = {pages._text_token(t["parent"], "Subscribe now for more.") for t in tokens}
    assert len(fixed.intersection(found["fixed"])) == 1


def test_templates_equal_those_of_explicit_vectors(spark):
    rng = random.Random(4)
    hosts = {f"h{h}": [page(i, t, ps, extra="<p>more</p>" * rng.randrange(3)) for i, t, ps in site(rng.randrange(1, 14))] for h in range(6)}
    hosts["copies"] = [page(k, f"Copy {k}", ["one two three " * 9]) + f"<section class='{name}'><p>unlike</p></section>" for k, name in ((1, "x"), (2, "y")) for _ in range(2)]
    hosts["copies"] += [page(i, t, ps) for i, t, ps in site(5)]
    rows = [(h, source) for h, sources in hosts.items() for source in sources]
    found = {r.host: r.asDict() for r in pages.templates(spark.createDataFrame(rows, "host string, html string").repartition(5)).collect()}
    for host, sources in hosts.items():
        assert found[host] == pages.deduce(*tokens_of(sources)) | {"host": host}


BOILERPLATE = {
    "ad": "<div class='ad'>buy thing number {i}</div>", "advert": "<div class='ad-slot'><p>offer {i}</p></div>", "notice": "<div class='cookie-notice'>we use {i} cookies</div>",
    "share": "<div class='share'>share it</div>", "related": "<div class='more'><ul><li><a href=x>Story {i}</a><li><a href=y>Other {i}</a></ul></div>",
    "comments": "<div class='comments'><div class='comment'><b>ann</b><p>reader {i} says a thing</p></div><div class='comment'><b>bo</b><p>and {i} more</p></div></div>",
    "replies": "<section class='voices'>" + "".join(f"<div class='v'><div class='who'>reader {k}</div><p>says {{i}} things</p></div>" for k in range(3)) + "</section>",
}


def test_slots_that_show_none_of_the_article_go(spark):
    rows, wanted = [], {}
    for i, title, paragraphs in site(12):
        text = "\n".join([title, *paragraphs])
        inner = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
        late = "".join(BOILERPLATE[k] for k in ("share", "ad", "related", "comments")).format(i=i)
        early = "".join(BOILERPLATE[k] for k in ("notice", "advert")).format(i=i)
        for name, html in {
            "in": f"<body>{early}<article>{early}{inner}{late}</article></body>", "beside": f"<body>{early}<div class='wrap'><div class='post'>{inner}</div>{late}</div></body>",
            "voices": f"<body><div class='post'>{inner}{BOILERPLATE['replies'].format(i=i)}</div></body>",
            "deep": "<body>" + "<div>" * 600 + f"<div class='wrap'><div class='post'>{inner}</div><div class='sidebar'>side words {i}</div></div>" + "</div>" * 600,
        }.items():
            for host in (name, f"{name}{i}"):  # with a template, and alone on its host
                for _ in range(1 + i % 2):  # some pages are repeated
                    rows.append((len(rows), f"https://{host}.example.com/", html))
                    wanted[len(rows) - 1] = text
    found = {r.page_id: r.text for r in pages.extract(pages_of(spark, rows)).collect()}
    assert {i: t for i, t in found.items() if t != wanted[i]} == {}


def test_the_template_decides():
    """A slot that its page alone would keep goes because of the host, and a fixed sentence with it."""
    sources = [page(i, t, ps, extra="".join(f"<div class='news-letter'><p>Write to us, edition {i}.</p></div>" for _ in range(i == 3))) for i, t, ps in site(12)]
    template = pages.deduce(*tokens_of(sources))
    assert all("Subscribe" in pages.main_text(s, None) and "Subscribe" not in pages.main_text(s, template) for s in sources)


def test_nesting_costs_linear_time():
    for deep in ("<div>" * 20_000 + "<p>x</p>" + "<div>a</div>" * 20_000, "<div>" * 20_000 + "<li>x" * 20_000, "<p><div>" + "<b>" * 20_000 + "<i>y</i><div>z</div></u>" * 20_000):
        assert pages.main_text(f"<article>{deep}</article>", None).count("\n") >= 19_999


# --- conversations

TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi <s>"), (1, 2, "assistant", "</s>[INST] x \\ <\\s>"), (2, 0, "assistant", "first"), (2, 1, None, None),
    (3, None, "tool|", "<|text|>"), (3, 5, "user", ""), (3, 5, "user", ""), (None, 1, "user", "alone"), (4, 0, "user", "q" * 300_000), (4, 1, "assistant", "é🙂" * 100_000),
]


def test_conversations_read_back_whole(spark):
    rows = spark.createDataFrame([(*t, "x", [1]) for t in TURNS], "conv_id long, turn long, role string, text string, valid string, segments array<int>")
    found = {r.conv_id: r for r in chat.read_back(chat.format_turns(rows.repartition(3))).collect()}
    for conv in {t[0] for t in TURNS}:
        mine = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] is not None, t[2] or ""))
        told = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in mine)
        learned = "".join(x for _, _, r, x in mine if r == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256(told.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert {c: r.valid for c, r in found.items()} == {1: True, 2: False, 3: False, None: False, 4: True}
    assert chat.read_back(chat.format_turns(rows.filter("false"))).count() == 0


def test_escapes_turn_back_and_hide_control_strings():
    escaper, rng = chat.Escaper(chat.DEFAULT), random.Random(1)
    parts = ["<", "s>", "/s>", "[", "INST]", "/INST]", "<SYS>>", "</SYS>>", "\\", "|", "role|>", "text|>", "end|>", "a", " "]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        safe = escaper.escape(text)
        assert escaper.unescape(safe) == text and not any(c in safe for c in chat.DEFAULT.controls())
        reader, role = chat.Reader(chat.DEFAULT, escaper), rng.choice(["user", "assistant", "system", "tool", "", text])
        assert reader.parse("".join(t for t, _ in chat.segments(role, text, chat.DEFAULT, escaper))) == (role, text)
    with pytest.raises(ValueError):
        chat.Escaper(chat.Template(other=("<\\", "b<", "c<")))


# --- vectors


def vector_table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab) for i, v, lab in rows], "vec_id long, embedding array<float>, label int")


def brute_links(rows, threshold=0.98):
    good = lambda v, lab: v is not None and lab is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    data = [np.array(v, np.float32).astype(float) if good(v, lab) else None for _, v, lab in rows]
    n, out = len(rows), []
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            a, b = data[i], data[j]
            if i != j and a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b):
                near[i, j] = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold
    top = list(range(n))
    for _ in range(n):
        new = [min([top[i], *[top[j] for j in np.flatnonzero(near[i])]]) for i in range(n)]
        if new == top:
            break
        top = new
    for i in range(n):
        out.append((rows[i][0], int(near[i].sum()), min(rows[j][0] for j in range(n) if top[j] == top[i])))
    return out


@pytest.mark.parametrize("block,window", [(8, 2), (2048, 32)])
def test_vector_links_match_brute_force(spark, block, window):
    rng = np.random.default_rng(3)
    rows, at = [], 0
    for label in (1, 2):
        for _ in range(12):
            centre = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 12))):
                rows.append((at, (centre + rng.normal(size=16) * rng.choice([0, 0.02, 0.1, 0.25])).tolist(), label))
                at += 1
    rows += [(at, None, 1), (at + 1, [0.0] * 16, 1), (at + 2, [1.0] * 15 + [None], 1), (at + 3, [float("nan")] * 16, 1), (at + 4, rows[0][1], None)]
    rows += [(at + 5, [1.0, 2.0], 1), (at + 6, [2.0, 4.0], 1), (at + 7, [], 1), (at + 8, [float("inf")] * 16, 2), (at + 9, rows[0][1], 1), (at + 10, [-0.0, 1.0], 2), (at + 11, [0.0, 1.0], 2)]
    found = vectors.near_duplicates(vector_table(spark, rows).repartition(4), block=block, window=window).collect()
    wanted = brute_links(rows)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == sorted(wanted)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert vectors.near_duplicates(vector_table(spark, [])).count() == 0


def test_more_rows_and_less_spread_need_more_passes():
    assert vectors.passes_needed(100) <= vectors.passes_needed(10**6) <= vectors.passes_needed(10**9)
    assert vectors.passes_needed(10**5, 1.0) <= vectors.passes_needed(10**5, 0.2) <= vectors.passes_needed(10**5, 0.1)


def crowded(background, n, pairs, rng, centre, label, first):
    """Unit vectors of which any two are at cosine ``background`` or so, and partners of the first ``pairs`` at .985."""
    dim, unit = len(centre), lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    rest = rng.normal(size=(n, dim))
    rest = unit(rest - (rest @ centre)[:, None] * centre)
    base = np.sqrt(background) * centre + np.sqrt(1 - background) * rest
    side = rng.normal(size=(pairs, dim))
    side = unit(side - (side * base[:pairs]).sum(1, keepdims=True) * base[:pairs])
    both = np.concatenate([base, 0.985 * base[:pairs] + np.sqrt(1 - 0.985**2) * side])
    return [(first + i, v, label) for i, v in enumerate(both.tolist())]


def test_links_are_found_in_crowded_labels(spark):
    """Labels off centre, and one of several dense groups, for which no mean tells anything."""
    rng = np.random.default_rng(8)
    rows = []
    for label, groups in enumerate(([0.8], [0.9], [0.95], [0.9] * 5)):
        for background in groups:
            centre = rng.normal(size=32)
            rows += crowded(background, 1500 // len(groups), 60 // len(groups), rng, centre / np.linalg.norm(centre), label, len(rows))
    found = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(vector_table(spark, rows).repartition(4), window=8).collect()}
    data, labels = np.array([v for _, v, _ in rows], np.float32).astype(float), np.array([lab for *_, lab in rows])
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    near = (data @ data.T >= 0.98) & (labels[:, None] == labels) & ~np.eye(len(rows), dtype=bool)
    assert sum(found[i][0] == n for i, n in enumerate(near.sum(1))) >= 0.999 * len(rows)
    a, b = np.nonzero(near)
    assert len(a) >= 400 and sum(found[i][1] == found[j][1] for i, j in zip(a.tolist(), b.tolist(), strict=True)) >= 0.99 * len(a)


def test_doubles_are_compared_as_doubles(spark):
    edge = 0.98 + 1e-12
    rows = [(0, [1.0, 0.0], 1), (1, [edge, float(np.sqrt(1 - edge**2))], 1), (2, [0.98 - 1e-12, -float(np.sqrt(1 - (0.98 - 1e-12) ** 2))], 1)]
    found = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted((r.vec_id, r.n_links) for r in found.collect()) == [(0, 1), (1, 1), (2, 0)]


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (np.round(rng.normal(size=6), 1)).tolist(), 0) for i in range(150)] + [(200, rows_ := [0.5] * 6, 0), (201, rows_, 0), (202, [0.0] * 6, 0)]
    rows += [(210, None, 0), (250, [None] * 6, 0), (300, [float("nan")] * 6, 0), (310, [1.0, 2.0], 0), (350, [3.0, 4.0], 0), (400, [], 0), (None, [1.0] * 6, 0)]
    table = vector_table(spark, rows).withColumn("score", vectors.F.lit("mine"))
    found = sorted(tuple(r) for r in topk.top_k(table.repartition(3), table.filter("vec_id % 50 = 0"), block=40, query_block=3).collect())
    code = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    wanted = []
    for q in code:
        if q % 50 == 0:
            scores = sorted((-int(code[q] @ c), i) for i, c in code.items() if i != q and len(c) == len(code[q]))[:5]
            wanted += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    assert found == sorted(wanted)
    assert topk.top_k(vector_table(spark, []), vector_table(spark, [])).count() == 0


def test_the_search_stops_early_where_it_can():
    values = np.zeros((4000, 2), np.int64)
    values[:, 0] = np.arange(4000)
    lists = topk.Lists(np.arange(4000), values)
    assert lists.top(np.array([1, 0]), -1, 3) == [(3999, 3999), (3998, 3998), (3997, 3997)]
    assert lists.top(np.array([-2, 0]), 0, 2) == [(-2, 1), (-4, 2)]
    assert lists.top(np.array([0, 0]), -1, 2) == [(0, 0), (0, 1)]
