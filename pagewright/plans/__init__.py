"""Registers every query of the library, by family."""

from ..sources import derived  # noqa: F401
from ..operators import bloat, files, images, ledger, lexis, links, markup, quality, reports, rules, seo, spelling, text, urls  # noqa: F401, I001
from ..streaming import events  # noqa: F401
