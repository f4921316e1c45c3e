import os
import random
import re

import pytest
from candela.llm import pages as p

RAGGED = '<html><head><title>T</title></head><body><nav><ul><li>x</ul></nav><div class="ad">buy</div><div class="post no-sidebar"><p>a &amp; b<br>c&nbsp; <b>d</b>e<p>f <a href="x>y">g</a><div class="comments"><p>hi</div>z</div><script>var t="</p>";</script><footer>&copy;'


def test_lines():
    assert [x for x, _ in p.lines(RAGGED)] == ["a & b", "c de", "f g", "z"]
    assert p.lines("<article><h1>A</h1><p><b>x\n y.<br><p>z</p><aside>q</aside><p>un&am") == [("A", True), ("x y.", True), ("z", True), ("un&am", True)]
    assert p.lines("") == [] and p.lines("a < b <p") == [("a < b", False)] and p.lines("<p>x<!-- never <p>y") == [("x", False)]
    assert p.lines('<p>a<span class="ad">B</span>c</p>') == [("ac", False)]
    assert p.lines("<main><form>n</form><textarea>n</textarea><div role=navigation>n</div>y<noscript>n") == [("y", True)]
    assert p.lines('<article><p aria-hidden="false">a<div class="comment-body">b</div><div class="ad-slot-3">c</div><ins class=adsbygoogle>d</ins><p class="lead">e<section id="reader-comments"><p>f</section><div hidden>g</div><div style="overflow:hidden">h</div>') == [("a", True), ("e", True), ("h", True)]
    assert p.lines("x" * 300_000) == [("x" * 300_000, False)]


def test_common_is_a_longest_common_subsequence():
    rng = random.Random(0)
    for _ in range(400):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = p.common(a, b)
        rest = iter(b)
        assert len(found) == best[-1][-1] and all(any(x == y for y in rest) for x in (a[k] for k in found))


def test_long_alignments_are_cut_in_halves(monkeypatch):
    rng = random.Random(1)
    pairs = [([rng.randrange(40) for _ in range(rng.randrange(90))] for _ in range(2)) for _ in range(60)]
    pairs = [tuple(x) for x in pairs]
    whole = [len(p.common(a, b)) for a, b in pairs]
    monkeypatch.setattr(p, "CELLS", 20)
    for (a, b), n in zip(pairs, whole):
        found = p.common(a, b)
        rest = iter(b)
        assert len(found) == n and all(any(x == y for y in rest) for x in (a[k] for k in found))


def parsed(page):
    """(line, whether marked) of the pages below, which have p and article elements only."""
    inside, out = False, []
    for tag, line in re.findall(r"(</?article>)|<p>([^<]+)", page or ""):
        inside = tag == "<article>" if tag else inside
        out += [(line, inside)] * bool(line)
    return out


def longest(a, b):
    """Places in a of a longest common subsequence with b, by the table of lengths."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = set()
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def brute(rows):
    """The text of each page, and how many of its lines differencing deleted, from all pages of its host."""
    out = []
    order = {}
    for key, url, page in rows:
        host, _, path = (url or "").removeprefix("http://").partition("/")
        order.setdefault(host if url else None, []).append(("/" + path, key, url, parsed(page)))
    for host, own in order.items():
        own.sort(key=lambda x: (x[0], x[1]))
        for k, (path, key, url, found) in enumerate(own):
            mine = [x for x, _ in found]
            differs = lambda j: [x for x, _ in own[j][3]] != mine  # noqa: E731, B023
            sides = [next((j for j in range(k - 1, -1, -1) if differs(j)), None), next((j for j in range(k + 1, len(own)) if differs(j)), None)]
            sides = [j for j in sides if j is not None and host]
            near = lambda j: len(os.path.commonprefix([own[j][0], path]))  # noqa: E731, B023
            shared = set()
            for j in sorted(sides, key=lambda j: (-near(j), abs(j - k) > 1)):  # noqa: B023
                shared = longest(mine, [x for x, _ in own[j][3]])
                if shared:
                    break
            alone = not sides and any(m for _, m in found)
            kept = [x for i, (x, m) in enumerate(found) if m or (i not in shared and not alone)]
            out.append((key, url, "\n".join(kept), sum(i in shared and not m for i, (_, m) in enumerate(found))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_main_text_equals_brute_force(spark, ranges):
    rng = random.Random(7)
    rows = []
    for k in range(120):
        host = rng.choice(["a.com", "a.com", "a.com", "b.org", f"c{k}.net"])
        menu = [f"menu {host} {j}" for j in range(4)]
        body = [f"line {rng.randrange(10**6)}" for _ in range(rng.randrange(1, 6))]
        inner = "".join(f"<p>{x}</p>" for x in body)
        page = "<div>" + "".join(f"<p>{x}" for x in menu[:2]) + (f"<article>{inner}</article>" if k % 4 == 0 else inner) + "".join(f"<p>{x}" for x in menu[2:])
        rows.append((k, f"http://{host}/{rng.choice('xyz')}/{rng.randrange(50)}", page))
    rows += [(200, "http://a.com/q", rows[1][2]), (201, "http://a.com/q", rows[1][2]), (202, None, "<p>no url"), (203, None, "<p>no url"), (204, "http://a.com/null", None), (205, "no scheme", "<p>q"), (206, "http://b.org/", "")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, text int")
    got = p.main_text(docs, ranges=ranges).collect()
    want = brute([r for r in rows if r[1] != "no scheme"]) + [(205, "no scheme", "q", 0)]
    assert sorted(((r.page_id, r.url, r.text, r.n_deleted) for r in got), key=repr) == sorted(want, key=repr)
    marked = {k for k in range(120) if k % 4 == 0}
    assert all("menu" not in r.text for r in got if r.page_id in marked)
    # on most marked pages that have a neighbour it is the alignment that deletes
    paired = [r for r in got if r.page_id in marked and "/c" not in r.url[:8]]
    assert sum(r.n_deleted > 0 and r.n_ruled == 0 for r in paired) > len(paired) / 2


def test_empty(spark):
    assert p.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_runs_of_copies_are_bridged(spark, ranges):
    """Inner pages of a run of copies are compared with the pages beyond it."""
    page = lambda *own: "".join(f"<p>{x}" for x in ("menu a", *own, "menu b"))
    rows = [(0, "http://a.com/a", page("first", "page"))]
    rows += [(k, f"http://a.com/c?{k}", page("copied", "text", "here")) for k in range(1, 60)]
    rows += [(60, "http://a.com/d", page("last", "page")), (61, "http://b.com/c", page("copied", "text", "here"))]
    got = {r.page_id: r for r in p.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), ranges=ranges).collect()}
    assert len(got) == 62 and all(got[k].text == "copied\ntext\nhere" and got[k].n_deleted == 2 for k in range(1, 60))
    assert got[0].text == "first\npage" and got[60].text == "last\npage"
    assert got[61].n_deleted == 0
