"""DataFrame operators: pipeline steps, filters, the ordered sink, details, images, output shape, statistics."""
