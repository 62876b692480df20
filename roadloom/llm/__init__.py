"""Operators for large text corpora, one module per operator; nothing else imports them."""
