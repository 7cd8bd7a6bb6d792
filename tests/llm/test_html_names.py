"""Names of elements inside content, headings beside it, comments in it, and raw elements."""

import time

import pytest

from sourcerank.llm import html_extract as he

TEXT = "One sentence of the text with some more words in it."
MORE = "Another paragraph of the text that belongs to it as well."


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<article><script src="a.js"/>var leaked = 1;</script><p>{TEXT}</p></article>', TEXT),
        (f'<article><style media="print"/>p {{ }}</style><p>{TEXT}</p></article>', TEXT),
        (f'<article><p>{TEXT}</p><section class="related-work"><p>{MORE}</p></section></article>', f"{TEXT}\n{MORE}"),
        (f'<article><p>{TEXT}</p><div class="social-history"><p>{MORE}</p></div></article>', f"{TEXT}\n{MORE}"),
        (f"<body><h1>The title</h1><article><p>{TEXT}</p></article></body>", f"The title\n{TEXT}"),
        (f"<body><nav>Menu</nav><h1>The <b>title</b></h1>\n<main><p>{TEXT}</p></main></body>", f"The title\n{TEXT}"),
        (f"<body><nav><h1>Menu</h1></nav><article><p>{TEXT}</p></article></body>", TEXT),
        (f'<main><p>{TEXT}</p><div class="user-reviews"><p>Very good.</p></div></main>', TEXT),
        (f'<main><p>{TEXT}</p><article class="comment"><p>I do not agree.</p></article></main>', TEXT),
        (f'<main><p>{TEXT}</p><ul class="comment-list"><li>I do not agree.</li></ul></main>', TEXT),
        (f'<article class="post"><p>{TEXT}</p><div class="ad">Buy</div><div class="cookie-notice">Take</div></article>', TEXT),
        (f"<article><p>{TEXT}</p></article><a href='/x'>a link between</a><article><p>{MORE}</p></article>", f"{TEXT}\n{MORE}"),
        (f"<article><p>one<!-- a -->two {TEXT}</p></article>", f"onetwo {TEXT}"),
        (f"<article><p>1 < 2 << 3 <</p><p>{TEXT}</p></article>", f"1 < 2 << 3 <\n{TEXT}"),
    ],
)
def test_text(page, want):
    assert he.main_text(page, he.Weights()) == want


def test_pages_teach_names():
    pages = [f'<body><article><div class="banner"><p>{TEXT} {k}</p></div></article><div class="teaser-strip"><p>Read on {k}</p></div></body>' for k in range(40)]
    names = he.learned_names(pages)
    assert he.Names().worth({"banner"}) < 0 < names.worth({"banner"})
    assert names.worth({"teaser", "strip"}) < 0 < he.Names().worth({"teaser", "strip"})


@pytest.mark.parametrize("page", ["<" * 100_000, "a<!---->" * 50_000, "<p>" * 50_000, "&" * 100_000, "<a b='" * 20_000])
def test_long_pages_take_linear_time(page):
    began = time.process_time()
    he.main_text(f"<article>{TEXT}</article>{page}", he.Weights())
    assert time.process_time() - began < 20
