"""The end of raw elements is found whatever letters stand before them."""

import pytest

from weft.llm import htmlmain


@pytest.mark.parametrize("tag", ["script", "STYLE", "iframe", "textarea"])
def test_dotted_capital_i_before_a_raw_element(tag):
    page = f"<html><body><article><p>{'İstanbul İzmir ' * 30}ve daha.</p><{tag}>var x = '</scripted>';</{tag} ><p>The rest, of the article.</p></article></body></html>"
    assert htmlmain.main_text(page).split("\n")[1:] == ["The rest, of the article."]
