"""Equivalence classes of page tokens: against a plain version, and what becomes of classes out of order or crossing."""

import collections

from factloom.llm import markup, pagetext


def page(k):
    links = "".join(f"<li><a>to {k} {j}</a></li>" for j in range(1 + k % 3))
    note = "<div class=t4>Now also <p>on paper</p></div>" if k % 4 else ""
    return f"<body><div class=t1>Welcome</div><div class=t2><ul>{links}</ul></div>{note}<div class=t3><p>Story {k} begins and goes on for a while</p></div><div>Bye</div></body>"


def plain_classes(sources):
    """Whole vectors of counts, compared as they are."""
    pages = {}
    for s in sources:
        found = markup.blocks(s)
        pages.setdefault(pagetext.content_of(found), pagetext.tokens_of(found)[0])
    names = sorted(pages)
    vectors = collections.defaultdict(set)
    for t in {t for tokens in pages.values() for t in tokens}:
        vector = tuple(pages[n].count(t) for n in names)
        on = sum(v > 0 for v in vector)
        if on > 1 and 2 * on >= len(names):
            vectors[vector].add(t)
    return {frozenset(own) for own in vectors.values() if len(own) > 1}


def test_classes_equal_plain_vectors(spark):
    rows = [("a", page(k)) for k in range(9)] + [("a", page(3))] * 4 + [("b", page(k)) for k in (20, 20)] + [("c", page(k)) for k in (1, 2)] + [("d", None), ("d", "")]
    once = pagetext.contents(spark.createDataFrame(rows, "host string, html string"))
    got = {r["host"]: r["patterns"] for r in pagetext.classes(once).collect()}
    by_host = collections.defaultdict(list)
    for host, source in rows:
        by_host[host].append(source)
    for host, sources in by_host.items():
        want = plain_classes(sources)
        assert {frozenset(p) for p in got.get(host, [])} == want
    assert set(got) == {"a", "c"} and len(got["a"]) >= 3


def test_deduced_template_leaves_the_slots(spark):
    rows = [(k, f"http://a.com/{k}", page(k)) for k in range(9)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {(r["page_id"], r["main_text"]) for r in pagetext.extracted(pages).collect()} == {(k, f"Story {k} begins and goes on for a while") for k in range(9)}


def test_order_and_nesting_of_classes():
    outer, inner, other = [1, 2, 3], [10, 11], [20, 21]
    assert pagetext.faults_of([1, 10, 11, 10, 11, 2, 20, 21, 3], [outer, inner, other]) == set()
    assert pagetext.faults_of([1, 10, 2, 11, 3], [outer, inner]) == {(1, 0)}
    assert pagetext.faults_of([1, 3, 2, 10, 11], [outer, inner]) == {(0, 0)}
    assert pagetext.faults_of([10, 20, 11, 21], [outer, inner, other]) == {(2, 1)}
    assert pagetext.faults_of([], [outer]) == pagetext.faults_of([7, 7], []) == set()
    assert pagetext.kept_tokens([outer, inner, other], set()) == [1, 2, 3, 10, 11, 20, 21]
    assert pagetext.kept_tokens([outer, inner, other], {(1, 0), (2, 1)}) == [1, 2, 3, 20, 21]
    assert pagetext.kept_tokens([outer, inner, other], {(0, 0), (1, 0)}) == [10, 11, 20, 21]
    assert pagetext.kept_tokens([], set()) == []


def test_tokens_open_and_close_in_their_roles():
    tokens, own = pagetext.tokens_of(markup.blocks("<body><ul><li>a<li>b</ul><p>a</p></body>"))
    count = collections.Counter(tokens)
    assert len(tokens) == 13 and len(count) == 11 and count[own[0][0]] == 2 and own[0][0] == own[1][0] and own[0][1] != own[2][1]
    assert pagetext.tokens_of([]) == ([], [])
    deep = markup.blocks("<div>" * 3000 + "deep")
    assert len(pagetext.tokens_of(deep)[0]) == 6001


def test_class_names_do_not_cost_text_of_an_article():
    source = ("<article><h1>T</h1><section class='social-impact'><p>Body</p></section><div id=related-work><p>Others</p></div>"
              "<div class='comment-list'><p>c</p></div><div class=ad-slot><p>buy</p></div></article><div class='site-header'>x</div>")
    assert pagetext.main_text(source, set()) == "T\nBody\nOthers"
    assert pagetext.main_text("<div class=social-impact>Whole text</div><div class='cookie-notice'>c</div>", set()) == "Whole text"


def test_very_long_page(spark):
    long = "<article>" + "".join(f"<p>word {k} and more</p>" for k in range(60000)) + "</article>"
    pages = spark.createDataFrame([(k, "http://a.com/", f"<div>Menu</div>{long}<p>{k}</p>") for k in range(2)], "page_id bigint, url string, html string")
    assert {len(r["main_text"].split("\n")) for r in pagetext.extracted(pages).collect()} == {60000}
