from hypothesis import given, settings
from hypothesis import strategies as st

from sextant.llm import splitting as s


def brute_blocks(text):
    """Blocks by a plain reading of the definition."""
    out, current, fenced = [], [], False
    for line in text.split("\n"):
        fence = line.startswith("```")
        if not line.strip() and not fenced:
            if current:
                out.append("\n".join(current))
            current = []
        else:
            current.append(line)
        if fence:
            fenced = not fenced
    if current:
        out.append("\n".join(current))
    return out


lines = st.lists(st.sampled_from(["", " ", "\t\r", "# head", "text words. More text!", "```", "```java", " ```", "- item", "a" * 30, "=====", "x\r", "1. one two three"]), max_size=25)


@settings(max_examples=300, deadline=None)
@given(lines)
def test_blocks_are_those_of_the_definition(parts):
    text = "\n".join(parts)
    assert [text[a:b].rstrip("\n") for a, b in s.blocks(text)] == [b.rstrip("\n") for b in brute_blocks(text)]


@settings(max_examples=300, deadline=None)
@given(lines, st.integers(12, 80))
def test_pieces_restore_the_text_and_keep_the_limit(parts, limit):
    body, overlap = "\n".join(parts).strip(), limit // 4
    spans = s.pieces(body, limit, overlap)
    assert all(0 < b - a <= limit for a, b in spans)
    rebuilt, end = "", 0
    for n, (a, b) in enumerate(spans):
        assert a == (max(0, end - overlap) if n else 0)
        rebuilt += body[end:b]
        end = b
    assert rebuilt == body


@settings(max_examples=200, deadline=None)
@given(lines, st.integers(5, 60))
def test_oversized_nodes_are_those_of_the_definition(parts, limit):
    body = "\n".join(parts).strip()
    want = [0] + [n for n, b in enumerate(brute_blocks(body), 1) if len(b.strip()) > limit] if len(body) > limit else []
    assert s.oversized(body, limit) == want


def test_boundaries_are_natural():
    text = "# One\n\n" + "First sentence here. " * 10 + "\n\n# Two\n\n" + "- item one is long\n" * 10
    cuts = [text.strip()[a:b] for a, b in s.pieces(text, 240, 20)]
    assert cuts[0].startswith("# One") and any(c[20:].startswith("# Two") for c in cuts[1:])
    assert [b - a for a, b in s.pieces("x" * 1000, 300, 50)] == [250, 300, 300, 300]


def paragraph(size):
    return ("Some words of a sentence here. " * (size // 30 + 1))[: size - 1] + "."


def test_tails_are_merged_with_what_follows():
    body = "\n\n".join(paragraph(n) for n in (3900, 600, 3900))
    spans = s.pieces(body)
    assert spans[0][1] >= 3900  # the first piece needs no room for an overlap
    new = [b - (spans[n - 1][1] if n else 0) for n, (a, b) in enumerate(spans)]
    assert all(x >= 380 for x in new[:-1]) and all(b - a <= 4000 for a, b in spans)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([5, 60, 350, 900, 2500, 3790, 3810, 3990, 4100, 9000]), min_size=2, max_size=9), st.sampled_from(["\n", "\n\n", " "]))
def test_no_small_pieces_before_the_last(sizes, between):
    body = between.join(paragraph(n) for n in sizes)
    spans = s.pieces(body)
    new = [b - (spans[n - 1][1] if n else 0) for n, (a, b) in enumerate(spans)]
    assert all(x >= 380 for x in new[:-1]) and sum(new) == len(body.strip()) or len(body.strip()) <= 4000


def test_lists_are_trees():
    items = [f"- item {i}\n" + "".join(f"  - sub {i}.{j} " + "word " * 12 + "\n" for j in range(8)) for i in range(12)]
    body = "".join(items).strip()
    cuts = {b for _, b in s.pieces(body, 1300, 100)[:-1]}
    assert all(body.startswith("- item", x) for x in cuts)  # between top items, as two of them fit
    deep = "".join(" " * n + "- x\n" for n in range(3000))
    assert s.pieces(deep)[-1][1] == len(deep.strip())


def test_rows(spark):
    rows = spark.createDataFrame(
        [(1, "S > T", "word " * 2000, "x"), (2, None, "short", "x"), (3, " ", None, "x"), (4, "s", "", "x"), (5, "s", " " * 5000, "x"), (6, "s", "𝄞" * 4001, "x"), (7, "s", " " + "y" * 4000 + "\n", "x"), (1, "S > T", "word " * 2000, "x")],
        "seq bigint, section string, text string, begins string",
    )
    got = s.split_texts(rows).collect()
    assert {r["seq"] for r in got} == {1, 6} and all(len(r["text"]) <= 4000 for r in got)
    assert all(r["section"] == "S > T" for r in got if r["seq"] == 1)
    assert sorted((r["seq"], r["block_no"]) for r in s.oversized_nodes(rows).collect()) == [(1, 0), (1, 0), (1, 1), (1, 1), (6, 0), (6, 1)]
    assert s.split_texts(rows.limit(0)).count() == 0
