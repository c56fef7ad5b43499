"""Estimation with many fixed effects on Spark tables."""

from .functions.columns import Panel, bin_column, cut_column, factor_columns, ref_levels
from .functions.order import quantiles
from .operators.did import aggregate, did_means, sunab
from .operators.models import ModelSet, collinearity, demean, feglm, felogit, femlm, fenegbin, fenmlm, feols, feols_fit, fepois, first_stages, update
from .operators.prepared import Prepared, prepare
from .operators.report import coefplot, etable, iplot
from .operators.tools import compare_keys, dictionary, n_unique, sample_rows, to_integer
from .operators.vcov import Ssc, Vcov, cluster, conley, driscoll_kraay, hetero, iid, newey_west

__all__ = [
    "ModelSet", "Panel", "Prepared", "Ssc", "Vcov", "aggregate", "bin_column", "cluster", "coefplot", "collinearity", "compare_keys", "conley", "cut_column", "demean", "dictionary", "did_means",
    "driscoll_kraay", "etable", "factor_columns", "feglm", "felogit", "femlm", "fenegbin", "fenmlm", "feols", "feols_fit", "fepois", "first_stages", "hetero", "iid", "iplot", "n_unique", "newey_west", "prepare", "quantiles", "ref_levels",
    "sample_rows", "sunab", "to_integer", "update",
]
