"""Main text of web pages whose contents are long: the same rules at every size."""

import random
import re

import pytest

from radiopos.llm import html


def prose(rng, words):
    return " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(words))


def shuffled(seed, many):
    """A page of `many` blocks in no order between two containers of one kind, a menu and text; and its text."""
    rng = random.Random(seed)
    blocks = [(t, prose(rng, 3)) for t in rng.choices(["p", "h2", "pre"], k=many)]
    end, menu = prose(rng, 40), " ".join(f"<a>menu{k}</a>" for k in range(4))
    source = "".join(f"<{t}>{x}</{t}>" for t, x in blocks)
    return f"<body><div>{menu}</div>{source}<div>{end}</div><h2>More</h2></body>", "\n".join([*(x for _, x in blocks), end])


@pytest.mark.parametrize("many", [50, 400, 500, 700, 2000])
def test_long_pages_are_read_as_short_ones(many):
    made = [shuffled(i, many) for i in range(6)]
    pages = [html.Page(source) for source, _ in made]
    wrapper = html.Wrapper.read(html.infer(pages).written())
    # by its host the first container is a list of links and the last heading is the template's
    assert [html.extract(p, wrapper) for p in pages] == [text for _, text in made]


def test_long_and_short_pages_of_a_table(spark):
    made = {(h, i): shuffled(10 * h + i, 700 if h % 2 else 60) for h in range(4) for i in range(6)}
    df = spark.createDataFrame([(10 * h + i, f"http://h{h}.example/{i}", source) for (h, i), (source, _) in made.items()], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.main_text(df, 10_000).collect()} == {10 * h + i: text for (h, i), (_, text) in made.items()}


def test_what_is_kept_at_once_changes_nothing(monkeypatch):
    pages = [html.Page(shuffled(i, 150)[0]) for i in range(4)]
    found = []
    for kept in (1, 10**4, 10**9):
        for name in ("ALIGNED", "KEPT"):
            monkeypatch.setattr(html, name, kept)
        wrapper = html.infer(pages)
        found.append((wrapper.nodes, [html.extract(p, wrapper) for p in pages]))
    assert found[0] == found[1] == found[2]


@pytest.mark.parametrize("seed", range(20))
def test_alignment_is_a_longest_common_subsequence(seed):
    rng = random.Random(seed)
    left, right = (rng.choices("abcde"[: rng.randint(2, 5)], k=rng.randint(0, 60)) for _ in range(2))
    longest = [[0] * (len(right) + 1)]
    for x in left:
        longest.append([0])
        for j, y in enumerate(right):
            longest[-1].append(longest[-2][j] + 1 if x == y else max(longest[-2][j + 1], longest[-1][j]))
    pairs = html.shared(left, right)
    assert len(pairs) == longest[-1][-1] and all(left[i] == right[j] for i, j in pairs)
    assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))


def random_items(rng, depth=0):
    return [(rng.choice("?*+"), tuple(random_items(rng, depth + 1))) if depth < 3 and rng.random() < 0.4 else rng.choice("abcd") for _ in range(rng.randint(1, 4))]


def word(rng, items):
    for x in items:
        if isinstance(x, str):
            yield x
        else:
            for _ in range(rng.randint(x[0] == "+", 1 if x[0] == "?" else 3)):
                yield from word(rng, x[1])


@pytest.mark.parametrize("seed", range(20))
def test_contents_match_as_regular_expressions(seed):
    rng = random.Random(seed)
    for _ in range(50):
        items = random_items(rng)
        content = html.Content(items)
        numbers = iter(range(len(content.members)))
        # one expression over the symbols, one over the members' numbers
        written = lambda items, sign: "".join(sign(x) if isinstance(x, str) else f"(?:{written(x[1], sign)}){x[0]}" for x in items)  # noqa: E731, B023
        symbols, members = re.compile(written(items, str)), re.compile(written(items, lambda _: chr(256 + next(numbers))))  # noqa: B023
        for k in range(10):
            keys = tuple(word(rng, items)) if k % 2 else tuple(rng.choices("abcd", k=rng.randint(1, 8)))
            found, whole = content.match(keys)
            assert [content.members[m] for m in found if m >= 0] == [x for x in keys if x in content.members]
            if keys:
                assert whole == content.fits(keys) == bool(symbols.fullmatch("".join(keys)))
            if keys and whole:
                assert members.fullmatch("".join(chr(256 + m) for m in found))


def random_page(rng, depth=0):
    out = ""
    for _ in range(rng.randint(1, 6)):
        name = rng.choice(["div", "p", "ul", "header", "h2", "div class=side"])
        text = rng.choice(["Printed by Example Press", "Read on", prose(rng, 5), "<a>x</a> <a>y</a> <a>z</a>"])
        out += f"<{name}>{random_page(rng, depth + 1) if depth < 3 and rng.random() < 0.5 else text}</{name.split()[0]}>"
    return out


@pytest.mark.parametrize("seed", range(10))
def test_written_wrappers_give_the_same(seed):
    rng = random.Random(seed)
    frame = [random_page(rng) for _ in range(3)]
    pages = [html.Page(f"<body>{frame[0]}{random_page(rng)}{frame[1]}{random_page(rng)}{frame[2]}</body>") for _ in range(12)]
    wrapper = html.infer(pages[:8])
    again = html.Wrapper.read(wrapper.written())
    assert [html.extract(p, wrapper) for p in pages] == [html.extract(p, again) for p in pages]
    assert any(html.extract(p, wrapper) != html.extract(p, None) for p in pages)
