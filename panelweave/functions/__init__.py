from panelweave.functions.numeric import (  # noqa: F401
    correlation,
    keyed_integer,
    keyed_normal,
    keyed_uniform,
    normal_upper_tail,
    rank_correlation,
    ratio,
)
