"""A Python worker goes from step to step: it holds the store of one step at a time."""

import gc
import weakref
from types import SimpleNamespace

from weftline.llm import tokenizing, toxicity
from weftline.runtime import release


def test_a_step_drops_the_store_of_the_step_before():
    weights = weakref.ref(toxicity._stored("m", SimpleNamespace(value=object())))
    assert weights() is toxicity._stored("m", None)
    tokens = weakref.ref(tokenizing.store(tokenizing.default_tokenizer()))
    gc.collect()
    assert weights() is None and tokens() is tokenizing.store(tokenizing.default_tokenizer())


def test_release_drops_what_is_kept():
    tokens = weakref.ref(tokenizing.store(tokenizing.default_tokenizer()))
    release()
    gc.collect()
    assert tokens() is None
