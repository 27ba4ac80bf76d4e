"""Pages whose text was lost or mixed with markup."""

import pytest

from tessera.llm import html_extract


@pytest.fixture(scope="module")
def model():
    return html_extract.train()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<head><meta charset=utf-8><title>t</title><article><p>Text of it, and more.", ["Text of it, and more."]),
        ("<html><head><link rel=x>\n<style>p {}</style><template><p>no</p></template> <article><p>Text of it, and more.</p>", ["Text of it, and more."]),
        ("<head><title>t</title> Plain text, and more.", ["Plain text, and more."]),
        ("<head><title>t</title><b>Bold</b> text, and more.", ["Bold text, and more."]),
        ("<head><script>a</script></head><body><p>Text of it, and more.</p></body>", ["Text of it, and more."]),
    ],
)
def test_open_head(model, page, want):
    assert html_extract.main_blocks(page, model) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article data-title="the hidden cost of x"><p title="a hidden gem">Text of it, and more.</p></article>', ["Text of it, and more."]),
        ("<article><p title='set display:none or aria-hidden=true'>Text of it, and more.</p></article>", ["Text of it, and more."]),
        ('<article><p data-style="display:none" style="--x:display:none">Text of it, and more.</p></article>', ["Text of it, and more."]),
        ("<article><p HIDDEN=''>no</p><p style='color:red; Display : none'>no</p><p aria-hidden=true>no</p><p>Text of it, and more.</p></article>", ["Text of it, and more."]),
        ("<article><p>The sum <math><mi>a</mi>+<mi>b</mi></math> is known, they say.</p></article>", ["The sum a+b is known, they say."]),
        ("<article><object data=x><param name=y><p>Text of it, and more.</p></object></article>", ["Text of it, and more."]),
    ],
)
def test_only_hidden_elements_go(page, want):
    assert [b for _, b in html_extract.Page(page).blocks] == want


@pytest.mark.parametrize("quote", ['"', "'"])
def test_long_values(quote):
    value = "a>b <i>" * 10_000
    tree = html_extract.Page(f"<article data-x={quote}{value}{quote} class=entry><p>Text of it, and more.</p></article>")
    assert [b for _, b in tree.blocks] == ["Text of it, and more."]
    assert tree.marks[1] == html_extract._marks(" class=entry")[0] != ()


def test_stray_quotes():
    """Quotes that open no value, and one that nothing closes, swallow no text."""
    for page in ("<article><p title=it's>Text of it.</p><p>It's 'more'.</p></article>", "<article><p class='x'\">Text of it.</p><p>It's 'more'.</p></article>", '<article><p title="x>Text of it.</p><p>It\'s \'more\'.</p></article>'):
        assert [b for _, b in html_extract.Page(page).blocks] == ["Text of it.", "It's 'more'."], page
    tags = '<p title="x" id=y>a</p>' * 40_000
    assert len(html_extract.Page(tags + '<p title="x>end').blocks) == 40_001
