"""Error texts and the conditions that raise them, in one place. The texts are fixed values that callers match on."""

from __future__ import annotations

TREE_MISSING = "Tree file not found."
TABLE_MISSING = "Table file not found."
TABLE_EMPTY = "Table file is empty."
NO_OVERLAP = "The table does not appear to be completely represented by the phylogeny."
UNKNOWN_METHOD = "Unknown method."
INVALID_METHOD = "Invalid method."
OUTPUT_ERROR = "Could not write output file."
GROUPING_MISSING = "PERMANOVA groupping not found."
NOT_A_TABLE = "Table does not appear to be a BIOM-Format v2.1"
NO_SAMPLES = "Table does not contain any samples"
ONE_SAMPLE = "Table must have at least two samples"
NEGATIVES = "Table has negatives"
NOT_NEWICK = "The phylogeny does not appear to be newick"
NO_DEPTH = "subsample_depth cannot be 0 if n_subsamples>1"
LENGTH_MISMATCH = "Length of ids and of a sample vector differ"
EMPTY_ID = "Empty ID found"


class MissingInput(IOError):
    """A file that was named is not there."""
