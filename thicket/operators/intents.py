"""What a question asks of the graph."""

from __future__ import annotations

import re

# Words that are no names, and the patterns of intents in their order.
STOPWORDS = set("who what calls call invokes callers callees callee of does made by uses usage used renders the a an is in on it this that them something anything".split())
HIERARCHY = [
    (r"\bwho (?:calls|invokes)\b", "callers"),
    (r"\bcallers? of\b", "callers"),
    (r"\bcallees? of\b", "callees"),
    (r"\bwhat does .* call\b", "callees"),
    (r"\bcalls made by\b", "callees"),
    (r"\bwho uses\b", "usage"),
    (r"\busage of\b", "usage"),
    (r"\bused by\b", "usage"),
]
TEMPLATE = [
    (r"\bwho (?:calls|invokes)\s+(\S+)", "who_calls", "name"),
    (r"\bcallers? of\s+(\S+)", "who_calls", "name"),
    (r"\b(?:files? )?depend(?:s|ing)? on\s+(\S+)", "files_depending_on", "dependency"),
    (r"\bwho (?:imports|uses the)\s+(\S+)\s+(?:package|dependency)\b", "files_depending_on", "dependency"),
    (r"\bunused\b.*\bcomponents?\b|\bcomponents?\b.*\bunused\b|\bunused (?:code|exports?)\b|\bnever (?:rendered|used)\b|\bdead components?\b", "unused_components", None),
    (r"\bcontext (?:flow|providers?)\b|\bproviders? and consumers\b", "context_flow", None),
    (r"\ball routes\b|\broute (?:table|list)\b|\blist (?:the )?routes\b", "routes", None),
]


def hierarchy_intent(question: str) -> tuple[str, list[str]] | None:
    """('callers' | 'callees' | 'usage', candidate names), or None where it asks for neither or names nothing."""
    kind = next((k for p, k in HIERARCHY if re.search(p, question, re.I)), None)
    names = [w for w in re.findall(r"[A-Za-z_$][A-Za-z0-9_$]*", question) if w.lower() not in STOPWORDS]
    return (kind, names) if kind and names else None


def template_intent(question: str) -> tuple[str, dict[str, str]] | None:
    """(template, parameters) that a question comes to; a name is what stands up to the next white space."""
    for pattern, template, param in TEMPLATE:
        m = re.search(pattern, question, re.I)
        if m:
            return template, {param: m[1]} if param else {}
    return None
