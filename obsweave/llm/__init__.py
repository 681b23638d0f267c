"""Training-data operators over the text and vectors of observations; nothing else imports this package."""
