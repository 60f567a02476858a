"""Many phrases as one pattern: a tree of their common beginnings, so that a text is searched once, not once a phrase."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column


def tree(phrases: Iterable[str]) -> str:
    """A pattern that matches exactly ``phrases``, each letter of a common beginning written once; of several at one place the shortest is found."""
    root: dict = {}
    for phrase in phrases:
        node = root
        for letter in phrase:
            node = node.setdefault(letter, {})
        node[""] = {}

    def spelled(node: dict) -> str:
        if "" in node:  # nothing longer is needed to know that a phrase is there
            return ""
        parts = [re.escape(letter) + spelled(below) for letter, below in sorted(node.items())]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return spelled(root)


def whole_tree(words: Iterable[str]) -> str:
    """As ``tree``, of words that stand whole: every end is an alternative."""
    root: dict = {}
    for word in words:
        node = root
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def spelled(node: dict) -> str:
        parts = [re.escape(letter) + spelled(below) for letter, below in sorted(node.items()) if letter]
        some = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")" if parts else ""
        return f"(?:{some})?" if "" in node and some else some

    return spelled(root)


def has_phrase(text: Column, phrases: Iterable[str]) -> Column:
    """Whether one of ``phrases`` stands anywhere in the text."""
    return text.rlike(tree(phrases))


def has_word(text: Column, words: Iterable[str], gaps: str) -> Column:
    """Whether one of ``words`` stands whole in the text, between its ends or characters of the class ``gaps``."""
    return text.rlike(rf"(?:^|[{gaps}]){whole_tree(words)}(?:$|[{gaps}])")
