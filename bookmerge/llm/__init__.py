"""Training-data operators: each module holds one operator; nothing outside this subpackage imports it."""
