import public_tokenizers

from attestor.llm import url_filter


def test_a_word_across_128_letters_is_found():
    split = url_filter.segmenter(public_tokenizers.path("word_bpe_49k.json"))
    name = "garden" * 21 + "casino" + "window" * 5  # casino holds the letters 127 to 132
    assert split.words(name) == ("garden",) * 21 + ("casino",) + ("window",) * 5
