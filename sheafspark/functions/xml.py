"""Small steps over XML trees by local names, whatever their namespaces."""

from __future__ import annotations

from xml.etree import ElementTree


def parse_xml(raw: bytes | str) -> ElementTree.Element:
    """The root; document types and entities are refused."""
    raw = raw.encode() if isinstance(raw, str) else raw
    if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw:
        raise ValueError("a document type is not allowed")
    return ElementTree.fromstring(raw)


def named(e) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def child(e, *names: str):
    """The first child of each name in turn; null where one is missing."""
    for n in names:
        if e is None:
            return None
        e = next((c for c in e if named(c) == n), None)
    return e


def attr(e, name: str, default: str | None = None) -> str | None:
    if e is None:
        return default
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), default)


def text_of(e) -> str:
    return "" if e is None else e.text or ""
