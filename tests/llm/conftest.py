from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from conftest_llm import awkward, prose, sf_dir, tokenizer  # noqa: E402

__all__ = ["awkward", "prose", "sf_dir", "tokenizer"]
