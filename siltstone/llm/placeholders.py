"""Notations of template placeholders that were never filled in."""

from __future__ import annotations

import re

# Notations of placeholders, by their first character.
PLACEHOLDER = re.compile(
    r"\{\{\{?[^{}\n]{1,60}\}\}\}?|\{%[^%{}]{1,60}%\}|\{[A-Za-z_]\w{0,30}\}|\{\d\}"
    r"|<%[^%<>]{1,60}%>|<!--[^<>]{0,60}-->|<\w+\s(?:\w+\s)?\w+>"
    r"|\$\{[\w.]{1,60}\}|\$[A-Z]+(?:_[A-Z]+)+\$|%%\w{2,60}%%|%\(\w{1,60}\)[sd]|%[sd](?!\w)"
    r"|\#\{[\w.]{1,60}\}|@@\w{2,60}@@|__[A-Za-z]+(?:_[A-Za-z]+)*__(?!\w)|&&\w{2,60}&&|\?\?\w{2,60}\?\?"
    r"|\[\[[^\[\]\n]{1,60}\]\]|\[(?:your|insert|enter|add|missing translation|object)\b[^\[\]\n]{1,60}\]"
    r"|:[a-z]+_[a-z]+:(?!\w)|\((?:\w+ ){1,3}to be (?:written|added|done)\)",
    re.I,
)
# Placeholders that are plain words.
PLACEHOLDER_WORDS = ("todo: ", "tbd - ", "xxxx-xxxx", "nan of undefined", "undefined undefined", "fill in before launch")


# Notations and field names from which examples of placeholders are made; @ stands for the field.
NOTATIONS = (
    "{{ @ }}", "{{@}}", "{{{ @ }}}", "{% @ %}", "{% block @ %}", "{@}", "{0}", "<%= @ %>", "<% @ %>", "${@}", "$@_@$", "%%@%%", "%(@)s", "%s", "%d", "#{@}", "__@__", "&&@&&", "??@??", "[[@]]", "[[ @ ]]", ":@_@:",
    "<@ @>", "<your @>", "[your @]", "[Your @ here]", "[insert @ here]", "[enter @]", "[add @]", "[missing translation: @]", "[object Object]", "(@ to be written)", "(@ to be added)", "(the @ to be done)", "<!--@-->",
    "TODO: add @", "TODO: @", "TBD - @", "XXXX-XXXX", "NaN of undefined", "undefined undefined", "fill in before launch",
)
FIELDS = "title name author page.title site_name user description date content first_name price company summary email link product header".split()


def examples() -> list[str]:
    """Placeholders of all notations and fields, as they stand in a text."""
    return [f" {n.replace('@', f)} " for n in NOTATIONS for f in FIELDS] + [f" @@{f}@@ " for f in FIELDS]


def has_placeholder(text: str) -> bool:
    """Does any placeholder stand in the text?"""
    if PLACEHOLDER.search(text):
        return True
    low = text.lower()
    return any(w in low for w in PLACEHOLDER_WORDS)


def is_placeholder(text: str) -> bool:
    """Is the text one placeholder and nothing else?"""
    return len(text) <= 80 and PLACEHOLDER.fullmatch(text) is not None
