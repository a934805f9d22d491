from shotspark.functions.expr import (
    NUMBER_RX, bias_label, is_finite, nan_to_null, np_round, null_if_na_text,
    round_doubles, shape_label, to_double,
)

__all__ = [
    "NUMBER_RX", "bias_label", "is_finite", "nan_to_null", "np_round",
    "null_if_na_text", "round_doubles", "shape_label", "to_double",
]
