"""Content in wrappers whose names sound like boilerplate, and self-closed elements."""

import pytest

from sourcerank.llm import html_extract

TEXT = "One sentence of the text with some more words in it."
ARTICLE = f"<article><p>{TEXT}</p></article>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<body><div class="page has-sidebar">{ARTICLE}</div></body>', TEXT),
        (f'<body><div id="social"><div class="related"><main><p>{TEXT}</p></main></div></div></body>', TEXT),
        (f'<body><div class="page has-sidebar"><p>{TEXT}</p></div></body>', TEXT),
        (f'<body><article><p>{TEXT}</p><div class="comments"><article><p>A comment.</p></article></div></article></body>', TEXT),
        (f'<body><article><p>{TEXT}</p></article><div class="sidebar"><p>Other things</p></div></body>', TEXT),
        (f"<body><aside>{ARTICLE.replace('One', 'Two')}</aside>{ARTICLE}</body>", TEXT),
        (f'<body><article><svg viewBox="0 0 1 1"/><p>{TEXT}</p></article></body>', TEXT),
        (f"<body><svg/><article><p>{TEXT}</p></article><svg><text>drawn</text></svg></body>", TEXT),
        (f'<body><article><svg width="1"><path d="M0"/></svg><p>{TEXT}</p></article></body>', TEXT),
    ],
)
def test_text_of_wrapped_content(page, want):
    assert html_extract.main_text(page, html_extract.Weights()) == want
