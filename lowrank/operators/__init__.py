"""Matrix operators: statistics, row maps, linear algebra and the EM fit."""
