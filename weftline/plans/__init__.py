"""Every query of the library; importing this registers them."""

from weftline.plans import dossiers, entities, evaluation, grids, records, redacted, retrieval, selection, studies, words  # noqa: F401
from weftline.registry import ORACLES, QUERIES  # noqa: F401
