"""Bindings of the test tables to the data model, and the registered queries over them."""
