import random
import time

from tessera.llm.html_text import extract_text, main_text

LONG = "This is a long paragraph, with commas, and enough words to be taken for text by anyone who reads it, surely."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_article_without_the_rest():
    body = (
        "<header><h2>Site</h2></header><nav><ul><li><a href='/'>Home</a></li></ul></nav><!-- <p>no</p> --><div class='cookie-notice'><p>We use, well, cookies, and so on, and so on, many of them.</p></div>"
        f"<article><h1>Title &amp; more</h1><p><b>{LONG}<br><p>Second\n  one &lt;b&gt;.</p><div id='ad_1'>Buy</div><p>Sh is.</p><form><input><p>Name, please</p></form></article>"
        f"<aside><p>{LONG}</p></aside><section class='comments'><p>{LONG}</p></section><footer>&copy; me</footer>"
    )
    assert main_text(page(body)) == f"Title & more\n{LONG}\nSecond one <b>.\nSh is."


def test_best_container_and_siblings():
    body = f"<div class='menu'><a href='#'>a</a></div><div><div><p>{LONG}</p><p>{LONG}</p></div><p>{LONG}</p><div><a href='#'>{LONG}</a></div></div><div>x</div>"
    assert main_text(page(body)) == "\n".join([LONG] * 3)


def test_broken_and_bare():
    assert main_text("") == "" and main_text("<p>") == "" and main_text("plain &amp; text") == "plain & text"
    assert main_text("<article><p>a<p>b<p>c &am") == "a\nb\nc &am"
    assert main_text("<article><p>a</p><script>never closed <p>b") == "a"
    assert main_text("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert main_text('<p title="a > b">x</p>') == "x"


def test_marks_inside_an_article():
    ids = f"<h2 id='related-work'>Work</h2><p id='copyright'>Law.</p><section id='discussion'><h2 id='side-effects'>Effects</h2><p>{LONG}</p></section><p>An <span id='notice'>inner</span> word.</p>"
    junk = "<div class='share'>Share this</div><div class='related'><p><a href='#'>Another one</a></p></div><div class='comments'><p>no</p></div>"
    assert main_text(page(f"<article><p>{LONG}</p>{ids}{junk}<ul><li><a href='#'>Source</a></li></ul></article>")) == f"{LONG}\nWork\nLaw.\nEffects\n{LONG}\nAn inner word.\nSource"


def test_marks_weigh_but_hold_no_content_back():
    assert main_text(page(f"<div class='layout has-sidebar'><article><h1>T</h1><p>{LONG}</p></article></div>")) == f"T\n{LONG}"
    assert main_text(page(f"<div class='layout sidebar'><div><p>{LONG}</p><p>{LONG}</p></div></div>")) == f"{LONG}\n{LONG}"
    assert main_text(page("<article><p>It costs <span class='share-price'>42</span> now<span class='ad'>buy <b>x</b></span>.</p></article>")) == "It costs 42 now."
    assert main_text(page(f"<article><header><h1>A</h1></header><div class='article-header'><h2>B</h2></div><p>{LONG}</p><p>An <img src=x> image.</p></article>")) == f"A\nB\n{LONG}\nAn image."


def test_points_decide_without_article_or_main():
    junk = f"<div class='comments'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div class='ad'><p>{LONG}</p></div><div class='x'><a href='#'>{LONG}</a></div>"
    body = f"<div class='wrap'><div class='text'><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><p>Short.</p></div>{junk}</div>"
    assert main_text(page(body)) == f"Head\n{LONG}\n{LONG}\nShort."
    assert main_text(page(body), scoring=False) != main_text(page(body))
    tiny = "<div class='ad'>" + LONG * 3 + "</div><article><h1>T</h1><p>Tiny.</p></article>"
    assert main_text(page(tiny)) == "T\nTiny."


def test_many_comments_and_layouts():
    comments = f"<div id='comments'>{f'<p>{LONG}</p>' * 30}</div>"
    for body in (f"<article><p>{LONG}</p>{comments}</article>", f"<main><article><p>{LONG}</p></article>{comments}</main>", f"<div><div><p>{LONG}</p></div>{comments}</div>"):
        assert main_text(page(body)) == LONG
    assert main_text(page(f"<main><div class='content-sidebar-wrap'><p>{LONG}</p><p>{LONG}</p></div></main>")) == f"{LONG}\n{LONG}"


def test_odd_quotes():
    assert main_text('<article><p title="oops>text</p><p class="x">more, or less</p></article>') == "text\nmore, or less"
    assert main_text("<article><p title='a > \"b'>it's</p><p title=\"<i>\">x</p></article>") == "it's\nx"


def test_large_pages_take_linear_time():
    n = 100_000
    for body in ("<div>" * n + "x", "<p>" + "<span class='ad'>x " * n, "<p title='x>t " * n, "<div><p>" * n + "<li>a" * n, "<div>" * n + "<p>a</p>" * n + "</section>" * n, "<b class=\"x " * n):
        began = time.process_time()
        main_text("<article>" + body)
        assert time.process_time() - began < 20
    assert main_text("<article>" + "<div>" * n + "x") == "x"


def test_random_pages_with_known_text():
    """Pages are built from a known text, so the builder is the oracle."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() + rng.choice(["", "", "", ",", "."]) for _ in range(n))
    for _ in range(300):
        title, parts, out = text(4), [], []
        for _ in range(rng.randint(2, 9)):
            t = text(rng.randint(20, 80))
            out.append(t)
            spaced = t.replace(" ", rng.choice([" ", "\n", "  ", "<!-- x --> "]))
            parts.append(rng.choice([f"<p>{spaced}</p>", f"<p>{spaced}", f"<p class='lead'>{spaced}</p>", f"<div><p>{spaced}</p></div>"]))
        if rng.random() < 0.5:
            parts.insert(rng.randint(0, len(parts)), f"<div class='{rng.choice(['ad', 'ads-box', 'newsletter'])}'>{text(9)}</div>")
        inner = f"<h1>{title}</h1>" + "".join(parts)
        middle = rng.choice([f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f"<div id='content'>{inner}</div>"])
        links = "".join(f"<li><a href='/'>{word()}</a></li>" for _ in range(6))
        around = [f"<nav><ul>{links}</ul></nav>", f"<div class='{rng.choice(['ad', 'cookie-notice', 'sidebar'])}'>{text(rng.randint(3, 12))}</div>", f"<aside><p>{text(30)}</p></aside>", f"<div class='menu'><ul>{links}</ul></div>"]
        rng.shuffle(around)
        found = main_text(page("".join(around[:2]) + middle + "".join(around[2:]) + f"<footer>&copy; {text(8)}</footer>"))
        assert found == "\n".join([title, *out])


def test_table(spark):
    rows = [(1, "u", "<article><p>a</p></article>", "t"), (2, None, None, "t"), (None, "v", "", None), (1, "u", "<article><p>a</p></article>", "t")]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, "u", "a", 1), (2, None, "", 0), (None, "v", "", 0), (1, "u", "a", 1)]))
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
