"""Tables, files, lakes and generators."""
