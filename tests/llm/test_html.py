"""Main texts of hand-made pages and hosts, block for block, wrappers of hosts, and their bounds."""

from __future__ import annotations

import random
import re

import pytest

from commitscope.llm import html_extract as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy now</div><div id="cookie-notice">We use cookies</div><aside class="sidebar">Side</aside>
<article><h1>Title &amp; more</h1><p>First <b>bold
text</b> here.<br>next<p>Second &eacute; &#233; &lt;tag&gt;<ul><li>one<li>two</ul><form><input value=x><button>Go</button></form>
<section class="comments"><h2>Comments</h2><p>nice post</p></section></article><footer>&copy; me</footer></body></html>"""


def test_article():
    assert h.extract(PAGE.format()) == "Title & more\n\nFirst bold text here. next\n\nSecond \u00e9 \u00e9 <tag>\n\none\n\ntwo"


def test_broken_markup():
    assert h.extract("<p>a<p>b<div>c</p>d") == "a\n\nb\n\nc\n\nd"
    assert h.extract("plain &amp; text") == "plain & text"
    assert h.extract("") == "" == h.extract("<script>never closed") == h.extract("<").replace("<", "")
    assert h.extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


@pytest.mark.parametrize("name", ['class="content no-sidebar"', 'class="share-price"', 'id="legal-analysis"', 'class="notice-period-law"'])
def test_names_that_only_contain_a_boilerplate_word(name):
    assert h.extract(f"<body><article><h1>T</h1><div {name}><p>Own text</p></div></article></body>") == "T\n\nOwn text"


@pytest.mark.parametrize("name", ['class="ad"', 'id="cookie-notice"', 'class="site-footer x"', 'class="post-comments"', "hidden", 'style="display: none"', 'role="navigation"', 'aria-hidden="true"'])
def test_names_and_marks_of_boilerplate(name):
    assert h.extract(f"<body><article><h1>T</h1><p>Own text of the page</p><div {name}><p>not this</p></div></article></body>") == "T\n\nOwn text of the page"


def test_names_are_void_where_nothing_else_is_text():
    assert h.extract('<body><div class="widget"><h1>T</h1><p>All of the text</p></div></body>') == "T\n\nAll of the text"


def test_a_header_inside_an_article_is_its_own():
    assert h.extract("<header>Site</header><article><header><h1>T</h1></header><p>Text</p><footer>By me</footer></article>") == "T\n\nText"


def test_inline_elements_do_not_cut_a_block():
    assert h.extract("<p>one <svg><text>x</text></svg>two <span class=share>three</span> <button>no</button>four</p>") == "one two three four"


def pages_of(spark, rows, **extra):
    return spark.createDataFrame([(*r, *extra.values()) for r in rows], "page_id long, url string, html string" + "".join(f", {k} string" for k in extra))


def test_wrapper_drops_template_text_without_a_marked_article(spark):
    rows = [(k, f"http://h.example/{k}", f"<body><div>Site name</div><div><a href=x>One</a> <a href=y>Two</a></div><div><p>Own text number {k} of this page</p></div><div>All rights kept</div></body>") for k in range(8)]
    got = {r.page_id: r.text for r in h.extract_pages(pages_of(spark, rows)).collect()}
    assert got == {k: f"Own text number {k} of this page" for k in range(8)}


def hosts(seed):
    """Pages of several hosts, each with a template of its own, and the blocks that are their own text."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    pages = []
    for host in range(6):
        brand, rights, invite = say(5), say(8), say(12)
        wrap = rng.choice(["div", "section"])
        marked = host % 3 == 0
        deep = "<div>" * (90 * (host % 2)), "</div>" * (90 * (host % 2))
        for k in range(rng.randint(6, 30)):
            blocks = [say(4)] + [say(rng.randint(8, 40)) for _ in range(rng.randint(1, 9))]
            menu = "".join(f"<li><a href=/{say(1)}>{say(2)}</a></li>" for _ in range(rng.randint(2, 9)))
            body = [f"<p>{x}</p>" for x in blocks[1:]]
            body.insert(rng.randint(0, len(body)), f"<p>{invite}</p>")  # template text between the own paragraphs
            if rng.random() < 0.4:
                body.append(f"<table><tr><td>{say(3)}<td>{say(4)}</table>")
                blocks += [x for x in re.findall(r"<td>([^<]*)", body[-1])]
            if rng.random() < 0.3:
                body.insert(1, f'<div class="{rng.choice(["ad", "promo-box", "newsletter"])}"><p>{say(9)}</p></div>')
            story = f"<h1>{blocks[0]}</h1>{''.join(body)}"
            story = f"<article>{story}</article>" if marked else f"<{wrap}>{story}</{wrap}>"
            text = f"<body><div>{brand}</div><ul>{menu}</ul>{deep[0]}{story}{deep[1]}<p>{rights}</p><footer>{say(6)}</footer></body>"
            pages.append((f"http://h{host}.example/{k}", text, blocks))
    return pages


@pytest.mark.parametrize("seed", range(2))
def test_labelled_hosts_block_for_block(spark, seed):
    """What is written on one page only is kept, block for block; menus, brands, invitations, adverts and rights are not."""
    pages = hosts(seed)
    rows = [(k, url, text) for k, (url, text, _) in enumerate(pages)]
    random.Random(seed).shuffle(rows)
    got = {r.page_id: r.text for r in h.extract_pages(pages_of(spark, rows).repartition(5)).collect()}
    for k, (_, _, blocks) in enumerate(pages):
        assert got[k].split("\n\n") == blocks, pages[k][0]


def wrapper_of(pages):
    found = [h.expression(h.slots(h.parse(x))) for x in pages]
    out = found[0]
    for x in found[1:]:
        out = h.align(out, x)
    return out


def test_alignment_makes_optional_and_repeated_groups_and_slots():
    one, two = "<div><h1>a</h1><p>x</p><p>y</p></div>", "<div><h1>b</h1><table><tr><td>1</table><p>x</p></div>"
    paths = [[s.path for s in h.slots(h.parse(x))] for x in (one, two)]
    pages, _, items = wrapper_of([one, two])
    assert pages == 2 and list(items) == [paths[0][0], paths[1][1], paths[0][1]]
    head, table, para = items.values()
    assert table[h.OPT] and not head[h.OPT] and not para[h.OPT]
    assert para[h.REP] and not head[h.REP] and not table[h.REP]
    assert sorted(n for n, _ in head[h.TEXTS].values()) == [1, 1] and max(n for n, _ in para[h.TEXTS].values()) == 2


def test_alignment_does_not_depend_on_the_order():
    pages = [text for url, text, _ in hosts(3) if "h1." in url]
    first = h.rules(wrapper_of(pages))
    for seed in range(5):
        random.Random(seed).shuffle(pages)
        assert h.rules(wrapper_of(pages)) == first


def test_a_wrapper_survives_being_sent():
    made = wrapper_of([text for url, text, _ in hosts(4) if "h2." in url])
    assert h._unpacked(h._packed(made)) == made


def test_wrappers_stay_small():
    wrapper = [0, [0, 0, 0], {}]
    for k in range(1500):
        page = "".join(f"<div class='c{chr(97 + (k * j) % 26)}{'xyz'[k % 3] * (k % 50)}'>{k * j}</div>" for j in range(20))
        wrapper = h.align(wrapper, h.expression(h.slots(h.parse(page))))
        if wrapper[0] % h.RARE == 0:
            h.prune(wrapper)
    assert len(wrapper[2]) <= h.RARE * 20 and sum(len(x[h.TEXTS]) for x in wrapper[2].values()) <= h.RARE * 20


def test_a_frequent_text_outlives_the_pruning():
    wrapper = [0, [0, 0, 0], {}]
    for k in range(950):
        wrapper = h.align(wrapper, h.expression(h.slots(h.parse(f"<p>own {k} and so on</p>" + "<p>join us</p>" * (k % 10 < 6)))))
        if wrapper[0] % h.RARE == 0:
            h.prune(wrapper)
    assert len(h.rules(wrapper)["const"]) == 1


def test_copies_of_one_page_make_no_template(spark):
    page = "<body><article><h1>One title</h1><p>The same story on many pages</p></article></body>"
    rows = [(k, f"http://h.example/{k}", page) for k in range(20)] + [(99, "http://h.example/x", page.replace("same", "other"))]
    got = {r.text for r in h.extract_pages(pages_of(spark, rows)).collect()}
    assert got == {"One title\n\nThe same story on many pages", "One title\n\nThe other story on many pages"}


def test_many_tasks_are_merged_in_a_tree(spark):
    rows = [(k, "http://h.example/x", f"<body><div>Site name</div><p>Own text number {k} of this page</p></body>") for k in range(300)]
    pages = pages_of(spark, rows).repartition(150).withColumn("host", h.host_of()).select("host", "html")
    found = h.host_rules(pages).collect()
    assert len(found) == 1 and len(h.json.loads(found[0].rule)["const"]) == 1


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "http://x.example/", ""), (3, "http://x.example/", "<p>hi</p>"), (3, "http://x.example/", "<p>hi</p>"), (None, "nothing", "<p>a\u00e9</p>"), (4, "http://y.example/", "<p>" + "long " * 200_000)]
    got = sorted(((r.page_id or 0, r.url, len(r.text)) for r in h.extract_pages(pages_of(spark, rows, host="h", rule="r", text="t")).collect()), key=str)
    assert got == sorted([(1, None, 0), (2, "http://x.example/", 0), (3, "http://x.example/", 2), (3, "http://x.example/", 2), (0, "nothing", 2), (4, "http://y.example/", 999_999)], key=str)
    assert h.extract_pages(pages_of(spark, [])).count() == 0


def blocks_of(article):
    """Blocks of an article of inline tags and p, h1 to h6, ul, li and br alone: cut at block tags."""
    parts = re.split(r"</?(?:p|h[1-6]|ul|ol|li|div|blockquote)(?:\s[^>]*)?>", article)
    texts = (" ".join(h.html.unescape(re.sub(r"<br\s*/?>", " ", x)).split()) for x in (re.sub(r"<(?!br)[^>]*>", "", x) for x in parts))
    return [x for x in texts if x]


def test_query_is_brute_force(spark, data):
    pages = {r.page_id: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = h.op2_html(spark, data).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url
        article = pages[r.page_id].html.split("<article>")[1].split("</article>")[0]
        assert [x for x in r.text.split("\n\n") if x] == blocks_of(article)


def test_own_text_behind_a_long_common_beginning_stays():
    intro = "A standing introduction of the paper. " * 10
    pages = [f"<body><div>Site name {'x' * 300}</div><p>{intro}Own story {k}</p></body>" for k in range(6)]
    rule = h.rules(wrapper_of(pages))
    assert [h.extract(page, rule) for page in pages] == [f"{intro}Own story {k}" for k in range(6)]


def test_a_text_that_begins_late_is_counted_on_all_its_pages(spark):
    """A template text that stands on the later half of a host's pages only, all read by one task."""
    rows = [(k, f"http://h.example/{k}", f"<body><div><p>Own text number {k} of this page</p></div>{'<div>Join us</div>' * (k >= 10_100)}</body>") for k in range(22_100)]
    pages = pages_of(spark, rows).coalesce(1).sortWithinPartitions("page_id")
    got = {r.page_id: r.text for r in h.extract_pages(pages).where("page_id % 50 = 0").collect()}
    assert got == {k: f"Own text number {k} of this page" for k in range(0, 22_100, 50)}


def test_a_link_list_on_few_pages_goes_from_each(spark):
    """Links under a path that two pages in 400 have: mostly links as a whole, half of the text on one of the two."""
    rows = [(k, f"http://h.example/{k}", f"<body><div><p>Own text number {k} of this page</p></div></body>") for k in range(400)]
    for k, more in ((7, "<li>Words that are no link but as long as the others are</li>"), (9, "<li><a href=z>Yet another one of the many links that lead away from here</a></li>")):
        rows[k] = (k, rows[k][1], rows[k][2].replace("</body>", f"<ul><li>x</li><li><a href=y>A link that leads to some other page</a></li>{more}</ul></body>"))
    got = {r.page_id: r.text for r in h.extract_pages(pages_of(spark, rows).repartition(3)).collect()}
    keeps = {7: "\n\nx\n\nWords that are no link but as long as the others are", 9: "\n\nx"}
    assert got == {k: f"Own text number {k} of this page" + keeps.get(k, "") for k in range(400)}


def test_what_leaves_a_wrapper_is_not_lost(monkeypatch):
    """Rows of a task, added up, are the wrappers of all its pages, however little it may hold."""
    pages = [(url.split("/")[2], text) for url, text, _ in hosts(5)] * 3 + [("late.example", f"<p>own {k}</p>" + "<p>join us</p>" * (k > 200)) for k in range(400)]

    def added(blocks):
        monkeypatch.setattr(h, "BLOCKS_HELD", blocks)
        batch = h.pa.RecordBatch.from_arrays([h.pa.array(c, h.pa.string()) for c in zip(*pages, strict=True)], names=["host", "html"])
        got = {}
        for r in (r for b in h._partial(iter([batch])) for r in b.to_pylist()):
            held = got.setdefault((r["host"], r["kind"], r["key"]), [0, 0, 0, 0, 0, set()])
            held[0] |= r["ev"]
            held[1:5] = [x + r[c] for x, c in zip(held[1:5], ("pages", "lists", "chars", "links"), strict=True)]
            held[5] |= set(r["mains"])
        return {k: (*v[:5], sorted(v[5]) if len(v[5]) < h.MIN_PAGES else None) for k, v in got.items()}

    whole = added(1 << 30)
    assert whole[("late.example", h.HOST, 0)][1] == 400 and len(whole) > 1000
    assert added(10) == added(700) == whole


def test_rules_of_rows_are_those_of_one_wrapper(spark):
    """Rules from the sums of many tasks are those of the wrapper aligned over all pages of the host."""
    rng = random.Random(9)
    pages = [(url.split("/")[2], text) for url, text, _ in hosts(6)]
    for k in range(330):  # rare paths, paths that are link lists on some pages only, texts on about half of the pages
        rare = f"<div class='r{'x' * (k % 150)}'>{'<a>' * (rng.random() < 0.5)}rare {k % 5}</div>"
        half = "".join(f"<section class=s{chr(97 + j)}><p>text {j}</p></section>" for j in range(8) if rng.random() < 0.5)
        role = rng.choice(["<p>in <span role=main>line</span></p>", "<p>out</p>", "<div class=widget>named text</div>"])
        pages.append(("many.example", f"<body><p>own {rng.randint(0, 250)} text</p>{role}{rare}{half}</body>"))
    found = h.host_rules(spark.createDataFrame(pages, "host string, html string").repartition(11)).collect()
    got = {r.host: h.json.loads(r.rule) for r in found}
    got = {host: rule | {k: sorted(x % 2**64 for x in rule[k]) for k in ("const", "links", "plain")} for host, rule in got.items()}
    assert len(found) == len(got) == 7 and got["many.example"]["links"] and got["many.example"]["plain"] and got["many.example"]["const"]
    assert got == {host: h.rules(wrapper_of([text for x, text in pages if x == host])) for host in got}


def test_pages_of_a_host_with_many_mixed_paths(spark, monkeypatch):
    """Where a host's paths are too many to go with every page, each page is judged as by the whole rule."""
    rng = random.Random(3)
    rows = [(k, f"http://few.example/{k}", f"<body><p>own {k}</p><p>join us</p></body>") for k in range(20)]
    for k in range(20, 320):
        some = [rng.randint(0, 60) for _ in range(4)]
        lists = "".join(f"<div class='r{'x' * n}'><a>to {k}</a>{' and some more' * (rng.random() < (0.7 if n < 30 else 0.2))}</div>" for n in some)
        rows.append((k, f"http://many.example/{k}", f"<body><p>own {k}</p><p>join us</p>{lists}</body>"))
    rows += [(k + 1000, url, text) for k, url, text in rows[20:60]]
    want = {}
    for host in ("few", "many"):
        mine = [r for r in rows if host in r[1]]
        rule = h.rules(wrapper_of([r[2] for r in mine]))
        want |= {k: h.extract(text, rule) for k, _, text in mine}
    assert len(rule["links"]) > 5 and len(rule["plain"]) > 5
    monkeypatch.setattr(h, "RULE_PATHS", 10)
    got = h.extract_pages(pages_of(spark, rows).repartition(4)).collect()
    assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want
