"""Errors of statements that cannot be run."""


class StatementError(ValueError):
    """A statement that does not parse or cannot be analysed."""


# Messages that clients compare.
MIXED_FUNCTIONS = "SetToSet/SetToRow/RowToRow functions can not be mixed in aggregate query."
MIXED_PATHS = "SetToSet/SetToRow functions and non-function modified path can not be mixed."
WINDOW_WITHOUT_FUNCTION = "Group by clause cannot be used without aggregate function."
ORDERED_AGGREGATE = "Not support ORDER BY clause in aggregate query."
EMPTY_INTERVAL = "Start time should be smaller than endTime in time interval."
DELETE_BY_VALUE = "delete clause can not use value or path filter."
DELETE_NOT_EQUAL = "Not support [!=] in delete clause."
DELETE_NOTHING = "This clause delete nothing, check your filter again."
