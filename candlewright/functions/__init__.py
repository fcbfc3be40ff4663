"""Column functions: guards, rounding, costs, calendar keys, text formats."""
