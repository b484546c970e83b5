"""Training-data operators: one module an operator, one query module, nothing else imports it."""
