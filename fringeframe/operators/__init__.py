"""DataFrame operators on visibility samples, images and components."""
