"""Documents of a project, and what is read back from them."""
