"""Training-data operators that work on whole corpora. Nothing else in quern imports this subpackage."""
