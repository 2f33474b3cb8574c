from sluice.llm import html_extraction as H

FRAME = '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav>{0}<footer>&copy; x</footer></body></html>'


def texts(spark, rows):
    frame = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, host string")
    return {r["page_id"]: r["text"] for r in H.extracted(frame).collect()}


def test_article_without_boilerplate(spark):
    body = '<div class="ad">Buy</div><article><header><h1>Head &amp; line</h1></header><p>One  <b>bold\n</b>text<br>more<p>Two &eacute; &#8364;</p><aside>Side</aside><form><p>Name</p></form><section class="comments"><p>First!</p></section></article><div id="cookie-notice">Cookies</div>'
    assert texts(spark, [(1, "http://a.com/1", FRAME.format(body))]) == {1: "Head & line\nOne bold text more\nTwo é €"}


def test_main_slot_and_template_text_of_a_host(spark):
    page = lambda i: f'<div class="wrap"><div class="top"><p>slogan {i}</p></div><div class="story"><p>Share this</p><p>{"words of page %d and more " % i * 20}</p><p>end {i}</p></div></div>'
    got = texts(spark, [(i, f"http://b.com/{i}", FRAME.format(page(i))) for i in range(8)])
    assert all(got[i] == " ".join((f"words of page {i} and more " * 20).split()) + f"\nend {i}" for i in range(8))


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain < 3 & text"), (4, "http://c", "<article><p>cut <b>off"), (4, "http://c", "<article><p>cut <b>off"), (5, "http://d", "<!-- <p>no</p> --><p title='a>b'>yes</p><!-- open"), (6, "http://e", "<script>never closed <p>x"), (7, "http://f", "<div>" * 3000 + "deep" + "</div>" * 3000), (8, "http://g", "<p>" + "long words " * 40_000), (9, "http://h", "</div></p><P>Upper<P CLASS=x>case")]
    got = texts(spark, rows)
    assert got == {1: "", 2: "", 3: "plain < 3 & text", 4: "cut off", 5: "yes", 6: "", 7: "deep", 8: ("long words " * 40_000).strip(), 9: "Upper\ncase"}


def test_join_by_host_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(H, "BROADCAST", 0)
    assert texts(spark, [(i, "http://b.com/", FRAME.format(f"<article><p>t{i}</p></article>")) for i in range(9)]) == {i: f"t{i}" for i in range(9)}
    assert texts(spark, []) == {}


def test_repeated_pages_keep_their_text(spark):
    same = FRAME.format('<article><h1>Head</h1><p>the only article</p></article>')
    lead = lambda i: f"<article><p>Lead of all</p><p>{f'own words {i} ' * 9}</p></article>"
    plain = FRAME.format('<div class="story"><p>one text in many copies</p></div>')
    rows = [(i, "http://a.com/", same) for i in range(6)] + [(10 + i, "http://b.com/", FRAME.format(lead(i))) for i in range(6)] + [(20 + i, "http://c.com/", plain) for i in range(6)]
    got = texts(spark, rows)
    assert {got[i] for i in range(6)} == {"Head\nthe only article"} and {got[20 + i] for i in range(6)} == {"one text in many copies"}
    assert all(got[10 + i].startswith("Lead of all\nown words") for i in range(6))


def test_classes_decide_what_is_template(spark):
    box = '<div class="box"><p>Follow us</p><p>Contact</p></div>'
    mixed = ["<p>Red</p><p>Blue</p>", "<p>Blue</p><p>Red</p>"]
    page = lambda i: f'<div class="story">{box if i < 6 else ""}<p>{f"words of page {i} and more " * 20}</p>{"<div class=pair>" + mixed[i % 2] + "</div>" if i > 2 else ""}</div>'
    got = texts(spark, [(i, f"http://b.com/{i}", FRAME.format(page(i))) for i in range(10)])
    assert not any("Follow us" in x or "Contact" in x for x in got.values())
    assert all("Red" in got[i] and "Blue" in got[i] for i in range(3, 10))


def test_letters_that_grow_when_lowered_move_nothing(spark):
    got = texts(spark, [(1, "http://a.com/", "<p>İİİİİİ</p><P>two words</P><p>ẞ<br>x</p>")])
    assert got == {1: "İİİİİİ\ntwo words\nẞ x"}


def test_deep_pages_take_time_in_proportion():
    import time

    began = time.time()
    for n in (100_000, 30_000):
        found, tree = H.read_page("<div><p>a</p>" * n + "</div>" * n + "<p>end</p>")
        assert len(found) == n + 1 and len(tree.ids) == n and found[-1] == (-1, "end")
        assert len(H.in_slot(found, tree, H.best_slot(H.slots_of(found, tree), n + 3))) > 0
    found, tree = H.read_page("<ul>" * 50_000 + "</div>" * 50_000)
    assert found == [] and time.time() - began < 20


def brute(pages):
    """Template texts of one host's pages, by its definition: explicit occurrence vectors, orders and nesting."""
    read = [H.read_page(h) for h in pages]
    seen, kinds, orders, parents = {}, {}, [], {}
    for i, (found, tree) in enumerate(read):
        line = []
        for own, parent, c in zip(tree.ids, tree.parents, tree.opened):
            seen.setdefault(own, {})[i] = c
            kinds[own] = ("path", None)
            parents[own] = tree.ids[parent] if parent >= 0 else None
            line.append(own)
        for node, block in found:
            own = tree.text_token(node, block)
            line.append(own)
            if node < 0 or not tree.article[node]:
                seen.setdefault(own, {})
                seen[own][i] = seen[own].get(i, 0) + 1
                kinds[own] = ("text", tree.ids[node] if node >= 0 else None)
        orders.append(line)
    classes = {}
    for own, where in seen.items():
        if all(c == 1 for c in where.values()) and len(where) >= H.SUPPORT * len(pages) and len(pages) >= H.TEXT_PAGES:
            classes.setdefault(frozenset(where), set()).add(own)
    out = set()
    for where, members in classes.items():
        if len(members) >= H.SIZE and len({tuple(x for x in orders[i] if x in members) for i in where}) == 1:
            for own in members:
                kind, above = kinds[own]
                while kind == "text" and above is not None and above not in members:
                    above = parents[above]
                if kind == "text" and above is not None:
                    out.add(own)
    return out


def test_template_texts_equal_brute_force(spark):
    import random

    draw = random.Random(11)
    for seed in range(6):
        pages = []
        for i in range(draw.randint(4, 12)):
            parts = [f"<div class=p{j}>" + "".join(f"<p>{draw.choice(['a', 'b', 'c', 'd'])}{j}</p>" for _ in range(draw.randint(1, 2))) + "</div>" for j in range(5) if draw.random() < 0.85]
            if draw.random() < 0.3:
                draw.shuffle(parts)
            pages.append("<body>" + "".join(parts) + f"<div class=story><p>{'long words ' * 9}{i}</p><p>tail</p></div></body>")
        frame = spark.createDataFrame([(i, "http://a.com/x", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
        got = H.templates(frame).collect()
        assert len(got) == 1 and set(got[0]["texts"]) == brute(pages)
