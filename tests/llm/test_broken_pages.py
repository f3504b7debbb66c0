"""Pages that are broken, or name their parts misleadingly."""

import time

import pytest

from quillspark.llm import html_main_text as H

BODY = "A paragraph of the article that is long enough to count as text, with many words in it. " * 3
BROKEN = ["<a " * 350_000, '<a ">" ' * 150_000, "<div>x" * 180_000, "<p class='a\">" * 80_000 + "'", "<!" * 500_000, "</script " * 100_000, "<script>" + "</script " * 100_000, '<a "' * 200_000 + ">", "<div>" * 150_000 + "</div>" * 150_000]


@pytest.mark.parametrize("page", BROKEN, ids=lambda p: p[:10])
def test_a_broken_page_takes_time_by_its_length(page):
    began = time.process_time()
    H.main_text(page)
    assert time.process_time() - began < 20  # seconds for a MB; by the square of its length it would be hours


def test_tags_end_outside_quotes_where_they_can():
    def tags(page):
        scan, at, out = H.Tags(page), 0, []
        while found := scan.next(at):
            at = found[1]
            out.append((page[found[0] : at], found[2], found[3]))
        return out

    assert tags('a <b c=">"> d </b >') == [('<b c=">">', "", "b"), ("</b >", "/", "b")]
    assert tags('<p class="x>text <i>') == [('<p class="x>', "", "p"), ("<i>", "", "i")]
    assert tags("1 < 2 <!-- <b> --> <!doctype html> <?x?> <br/> < p> <q") == [("<!-- <b> -->", "", ""), ("<!doctype html>", "", ""), ("<?x?>", "", ""), ("<br/>", "", "br")]
    assert tags("<!-- open <b>") == [("<!-- open <b>", "", "")]
    # The third single quote has no fellow, so the tag ends at its first mark.
    assert tags("<a '<b \"x\">' <c '>\">") == [("<a '<b \"x\">", "", "a"), ("<c '>", "", "c")]


@pytest.mark.parametrize("name", ["share-price", "comment-analysis", "alert-system", "navigation-history", "promo-results"])
def test_a_hint_yields_to_text_within_an_article(name):
    page = f'<html><body><article><h1>T</h1><p>{BODY}</p><div class="{name}"><p>{BODY}Own.</p></div><p>{BODY}</p></article></body></html>'
    assert H.main_text(page).count("Own.") == 1
    aside = f'<html><body><article><h1>T</h1><p>{BODY}</p></article><div class="{name}"><p>{BODY}Own.</p></div></body></html>'
    assert "Own." not in H.main_text(aside)


def test_deep_elements_count_for_the_last_that_is_told_apart():
    deep = "<div>" * 1000 + f"<p>{BODY}</p>" + "</div>" * 1000
    page = f"<html><body>{deep}<footer>{BODY}Foot.</footer></body></html>"
    text = H.main_text(page)
    assert text == BODY.strip()
