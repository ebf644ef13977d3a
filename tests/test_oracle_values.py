"""Oracles state every list, weight, template and pattern themselves."""

import subprocess
import sys

import quarry.oracle as O
from quarry.functions import prompts as P
from quarry.functions import sqltokens as K
from quarry.functions import text as T
from quarry.operators import augment as AU
from quarry.operators import compare as CMP
from quarry.sources import adapters as A


def test_the_oracle_module_imports_nothing_of_the_library():
    code = ("import sys, importlib.abc\n"
            "class Block(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name.startswith(('quarry.functions', 'quarry.sources', 'quarry.operators')): raise ImportError(name)\n"
            "sys.meta_path.insert(0, Block())\n"
            "import quarry.oracle as O\n"
            "assert 'SELECT' in O.statement_type('sql') and 'winners' in O.CLASSIFIED\n")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_both_statements_agree():
    """The two statements of a fixed value are written apart; a slip in one of them shows here by name."""
    assert O.TEMPLATES == P.TEMPLATES and set(O.TRIMMED) == P.TRIMMED and O.INSTRUCTION == P.INSTRUCTION and O.FEW_SHOT_HEAD == P.FEW_SHOT_HEAD
    assert O.PARAPHRASES == AU.PARAPHRASE_RULES and O.SYNONYMS == AU.TABLE_SYNONYMS
    assert (O.DUCKDB_WORDS, O.POSTGRES_WORDS, O.KNOWN_TYPES) == (T.DUCKDB_KEYWORDS, T.POSTGRES_SPECIFIC, T.KNOWN_STATEMENT_WORDS)
    assert O.COMPLEXITY == T.SQL_PATTERNS and O.SQL_ENDS == T.SQL_END_DELIMITERS and O.ERROR_CLASSES == T.ERROR_CLASSES
    assert O.SQL_WORDS == K.KEYWORDS and O.FROM_ENDS == K.FROM_LIST_END and O.WS == K.WS
    assert dict(zip(O.SOURCES, O.PRIORITIES)) == A.SOURCE_PRIORITY and O.METHODS == A.METHODS and O.ERRORS == A.EVAL_ERRORS
    assert (O.MSG_NORMALIZE, O.MSG_MATCH, O.MSG_DIFFER) == (CMP.MSG_NORMALIZE, CMP.MSG_MATCH, CMP.MSG_DIFFER)
